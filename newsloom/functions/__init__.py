"""Functions of the news digest."""
