"""Column functions and ordering."""
