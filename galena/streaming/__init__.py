"""Structured Streaming jobs. Each has a batch twin that gives the same rows."""
