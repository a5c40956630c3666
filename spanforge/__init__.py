"""Interval, structure and abundance analytics as PySpark DataFrame operators."""
