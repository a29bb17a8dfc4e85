"""Column functions and small frame functions that the operators are put together from."""
