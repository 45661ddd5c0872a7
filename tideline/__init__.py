"""Ordered event delivery and its analytics on PySpark."""
