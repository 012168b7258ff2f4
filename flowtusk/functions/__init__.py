"""Column expressions: flow keys, addresses, header fields."""
