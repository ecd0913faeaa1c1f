"""Ranked-catalog analytics as lazy Spark DataFrame operators."""
