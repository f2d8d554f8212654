"""Scoring and curating SQL-generation data as Spark DataFrame jobs."""
