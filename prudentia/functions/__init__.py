"""Column expressions: periods, text and display."""
