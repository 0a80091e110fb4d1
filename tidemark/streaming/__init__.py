"""Structured Streaming jobs that give the batch results on live data."""
