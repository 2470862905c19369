"""Column builders: vectors and paths."""
