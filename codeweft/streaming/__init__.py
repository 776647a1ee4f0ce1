"""Structured Streaming operators; each has a batch twin that gives the same closed windows."""
