"""Column functions: pure expressions, no joins, no shuffles."""
