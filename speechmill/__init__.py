"""Spark-first analytics for text and speech corpora."""
