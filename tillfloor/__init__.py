"""Sales and production analytics as Spark DataFrame operators."""
