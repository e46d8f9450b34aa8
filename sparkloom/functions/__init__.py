"""Column builders; Arrow functions only where Spark has no equivalent."""
