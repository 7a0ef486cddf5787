"""Column expressions and the fixed configuration they read."""
