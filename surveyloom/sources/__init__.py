"""Scans, sinks and the table bindings."""
