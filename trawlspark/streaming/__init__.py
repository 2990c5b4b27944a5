"""Structured Streaming jobs over the feed of fetch results."""
