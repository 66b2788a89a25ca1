"""Spark-first analytics over media-library catalogs."""
