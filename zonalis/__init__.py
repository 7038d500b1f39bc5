"""Spatial allocation on PySpark."""
