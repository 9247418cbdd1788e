"""Column functions: gated rolling windows, option pricing."""
