"""Column functions: text, formulas, vectors."""
