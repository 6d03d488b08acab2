"""Spark-native analytics over source repositories, agent transcripts and text corpora."""

__version__ = "0.1.0"
