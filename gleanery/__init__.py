"""Gleanery: a Spark-first engine that gathers, resolves and exports listing data."""
