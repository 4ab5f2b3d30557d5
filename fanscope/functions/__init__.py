"""Column expressions built from Spark built-ins (no Python UDFs)."""
