"""Column functions over flat arrays of a constant shape."""
