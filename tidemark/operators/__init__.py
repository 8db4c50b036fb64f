"""Operators on frames that Spark has no word for."""
