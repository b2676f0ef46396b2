"""Chat-log analytics as Spark DataFrame operators."""
