"""Choice of the physical form of a search."""
