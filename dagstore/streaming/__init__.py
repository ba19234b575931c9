"""Streaming forms of logs, leases, rate limits, events and periodic maintenance."""
