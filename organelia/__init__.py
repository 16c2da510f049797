"""Spark-first analytics over organelle-genome project data."""

__version__ = "0.1.0"
