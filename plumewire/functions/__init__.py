"""Column functions: text, time and statistics."""
