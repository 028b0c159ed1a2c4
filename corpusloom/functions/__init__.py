"""Column expressions: URLs, names, version labels and text."""
