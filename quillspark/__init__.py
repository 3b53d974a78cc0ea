"""Curation, evaluation and serving of labelled samples as Spark DataFrame jobs."""
