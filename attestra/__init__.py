"""Spark-first analytics over coded statements, reviews and text corpora."""

__version__ = "0.1.0"
