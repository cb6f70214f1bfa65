"""Financial-observation analytics as Spark DataFrame operators."""
