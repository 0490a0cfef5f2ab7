"""Structured Streaming operators: append-only admission, binding, incremental sums."""
