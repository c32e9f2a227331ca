"""Unsupervised anomaly analytics on tables, expressed as Spark DataFrame operators."""
