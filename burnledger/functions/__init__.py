"""Column expressions: clock arithmetic, scalar helpers and labels."""
