"""Column expressions: geometry, text, quality flags."""
