"""Getting values into rules, and results out."""
