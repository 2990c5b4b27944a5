"""Crawl-corpus analytics as Spark DataFrame and Structured Streaming jobs."""
