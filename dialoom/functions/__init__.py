"""Column functions: every function takes columns (or column names) and returns a Column."""
