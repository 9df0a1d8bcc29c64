"""The task graph's windows and merges as Structured Streaming."""
