"""Column functions; every one is a built-in expression, no Python workers."""
