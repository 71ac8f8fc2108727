"""Structured Streaming over folders that alignment files keep arriving in."""
