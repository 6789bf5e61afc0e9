"""Column functions: names, text, JSON and ids."""
