"""Spark-first text evidence analytics.

Everything is DataFrame in, DataFrame out; nothing here collects a table to the driver.
"""

__version__ = "0.1.0"
