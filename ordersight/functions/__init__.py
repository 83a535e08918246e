"""Column expressions (built-in Spark SQL functions only, no UDFs)."""
