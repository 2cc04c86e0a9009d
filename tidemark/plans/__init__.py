"""Measurements, queries over them, and the catalog."""
