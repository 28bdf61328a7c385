"""Sources of the news digest."""
