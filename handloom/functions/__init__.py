"""Column builders: every function here returns Spark expressions."""
