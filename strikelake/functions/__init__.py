"""Column-to-Column functions; everything here stays inside Spark expressions."""
