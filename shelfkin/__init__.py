"""Catalog similarity, explanation and evaluation as Spark DataFrame jobs."""
