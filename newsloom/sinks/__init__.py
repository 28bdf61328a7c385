"""Sinks of the news digest."""
