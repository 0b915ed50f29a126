"""Column expressions: names and paths, value types, question text."""
