"""Research-trend analytics as Spark DataFrame operators."""
