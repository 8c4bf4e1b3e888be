"""Operators for large training-data pipelines: one module each, Spark jobs throughout."""
