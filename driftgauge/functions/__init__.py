"""Column expressions of a scan."""
