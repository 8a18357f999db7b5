"""Spark-first research engine for daily price bars."""

__version__ = "0.1.0"
