"""Column expressions and row filters; built-in Spark functions only."""
