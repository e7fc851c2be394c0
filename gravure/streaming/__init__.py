"""Structured Streaming jobs over request logs and landing folders."""
