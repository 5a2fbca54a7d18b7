"""Column expressions and the registry of user functions."""
