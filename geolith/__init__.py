"""A Spark-first spatial and relational analytics engine."""

__version__ = "0.1.0"
