"""Column -> Column helpers. None of them runs Python per row."""
