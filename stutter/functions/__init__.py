"""Column expressions and the array helpers used inside Spark tasks."""
