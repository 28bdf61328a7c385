"""Plans of the news digest."""
