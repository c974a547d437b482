"""Column expressions: text to money and dates, classification, display text."""
