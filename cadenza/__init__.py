"""Sequence analytics and training-data operators for Apache Spark."""
