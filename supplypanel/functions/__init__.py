"""Column functions: arithmetic, parsing and display text."""
