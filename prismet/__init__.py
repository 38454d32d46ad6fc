"""Concept analytics on Spark: DataFrame-first operators for sparse concept discovery."""
