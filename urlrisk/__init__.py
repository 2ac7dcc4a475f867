"""Spark jobs that find risky URLs and messages in large tables and streams."""

__version__ = "0.1.0"
