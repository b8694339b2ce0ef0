"""Insurance claims analytics as Spark DataFrame operators."""
