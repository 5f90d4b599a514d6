"""Column helpers, fixed word lists and SQL functions."""
