"""Option-strategy analytics as Spark DataFrame transforms."""
