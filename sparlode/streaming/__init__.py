"""Structured Streaming into a database (an extension)."""
