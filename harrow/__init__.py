"""harrow: funding-catalogue analytics as Spark DataFrame operators."""
