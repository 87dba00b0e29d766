"""Limit-order-book analytics as PySpark DataFrame operators."""
