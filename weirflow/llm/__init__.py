"""Operators of a training-data pipeline, as Spark jobs."""
