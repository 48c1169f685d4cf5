"""Scans, sinks and the mapping of order tables to accounts."""
