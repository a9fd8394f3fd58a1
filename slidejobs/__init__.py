"""Spark jobs that score very large tissue images kept as tables."""
