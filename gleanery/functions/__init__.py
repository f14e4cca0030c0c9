"""Column functions over built-in expressions."""
