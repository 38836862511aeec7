"""Spark-first analytics for event and document data."""
