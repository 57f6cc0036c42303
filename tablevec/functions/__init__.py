"""Column functions and small relational building blocks."""
