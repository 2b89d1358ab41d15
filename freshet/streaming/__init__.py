"""Structured Streaming forms of the readings load."""
