"""Streaming of the news digest."""
