"""Column expressions: text, numbers, intervals, n-grams, vectors."""
