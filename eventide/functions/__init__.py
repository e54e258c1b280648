"""Column functions on arrays."""
