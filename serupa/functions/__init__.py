"""Column expressions: text, exact rounding, scores, vectors."""
