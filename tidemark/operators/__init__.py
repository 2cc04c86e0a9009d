"""Operators on measurements; each gives a lazy DataFrame or measurement."""
