"""Structured Streaming jobs over the same column expressions as the batch jobs."""
