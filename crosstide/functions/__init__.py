"""Column expressions: dates, numbers and text."""
