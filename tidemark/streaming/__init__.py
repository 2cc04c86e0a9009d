"""Continuous queries, retention and compaction of measurement tables."""
