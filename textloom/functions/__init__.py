"""Scalar column functions: expressions only, no DataFrame and no job."""
