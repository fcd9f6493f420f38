"""Spark-first procedure mining and text data processing.

Operators are functions from DataFrame to DataFrame (or Column to Column);
nothing here collects rows to the driver.
"""
