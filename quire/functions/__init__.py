"""Column-level scalar functions (pure Spark expressions, no UDFs)."""
