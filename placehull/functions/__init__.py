"""Column functions: coordinates, rings, text."""
