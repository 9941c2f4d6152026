"""The operators applied to the given tables, and the same results in SQL."""
