"""Column builders: each returns Spark expressions and touches no data."""
