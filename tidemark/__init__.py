"""Tidemark: reusable, incrementally maintained query results on Spark."""
