"""Column functions: scalars, arrays, and the algebra of half-open intervals."""
