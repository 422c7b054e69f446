"""Where a graph comes from."""
