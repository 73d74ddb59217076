"""Paired Spark queries and SQL cross-checks over the generated test tables."""
