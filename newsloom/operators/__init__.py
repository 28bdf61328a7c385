"""Operators of the news digest."""
