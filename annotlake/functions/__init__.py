"""Column helpers: expressions only, no UDFs."""
