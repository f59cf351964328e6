"""Temporal alignment and analytics operators as Spark DataFrame transforms."""
