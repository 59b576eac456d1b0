"""Column expressions over property lists and typed property values."""
