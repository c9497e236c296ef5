"""Column functions and scalar functions."""
