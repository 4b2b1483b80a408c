"""Corpus triage on Spark: features, labels, a classifier and exploration queries over text tables."""

__version__ = "0.8.1"
