"""Column expressions, and the numpy arithmetic used inside tasks."""
