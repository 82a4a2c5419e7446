"""Column functions: they take and return columns, and take the clock as an argument."""
