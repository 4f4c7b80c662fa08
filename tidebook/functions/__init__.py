"""Column functions of the book domain."""
