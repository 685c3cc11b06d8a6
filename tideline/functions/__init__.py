"""Column functions: calendar, nulls, labels."""
