"""Continuous runs on Structured Streaming."""
