"""Column functions: amounts, dates, text, tax codes."""
