"""Column types and typed expressions."""
