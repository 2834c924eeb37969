"""The operators, by family."""
