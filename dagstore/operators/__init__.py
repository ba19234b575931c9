"""Relational operators over objects, refs, logs, leases and metrics."""
