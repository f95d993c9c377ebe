"""Column functions for text, dates and positions."""
