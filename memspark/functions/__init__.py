"""Column functions: expressions that Catalyst compiles, no Python per row."""
