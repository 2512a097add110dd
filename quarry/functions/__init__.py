"""Column functions of the dialect."""
