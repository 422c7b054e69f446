"""Column expressions the operators share."""
