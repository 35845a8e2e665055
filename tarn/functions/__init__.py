"""Column functions: text, paths and vectors."""
