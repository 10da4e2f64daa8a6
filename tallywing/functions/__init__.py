"""Column functions; each takes and returns Column expressions."""
