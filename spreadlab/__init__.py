"""Spark jobs that measure how posts spread on social networks."""
