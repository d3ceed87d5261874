"""Built-in functions, and the registry that user functions join."""
