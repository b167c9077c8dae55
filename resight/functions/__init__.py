"""Column functions: text, identity, time and small values."""
