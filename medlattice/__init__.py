"""Spark-first analytics over versioned clinical documents and text corpora."""
