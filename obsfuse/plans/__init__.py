"""Composite plans, adapters over the driver tables, and the query catalogue."""
