"""Structured Streaming jobs over growing log folders and event tables."""
