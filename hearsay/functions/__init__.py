"""Column functions: scalars, times, text."""
