"""Column functions: plain expressions, no Python UDFs."""
