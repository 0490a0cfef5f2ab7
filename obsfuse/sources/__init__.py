"""Ingest jobs, manifest scans, table sinks and guards."""
