"""Column expressions and small helpers the operators are composed of."""
