"""Structured Streaming forms of the load job, the transfer plan and the counters."""
