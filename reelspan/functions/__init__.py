"""Column functions: text, geometry and vectors."""
