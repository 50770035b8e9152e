"""Document-processing analytics as Spark DataFrame operators."""
