"""Spark-first text analytics: page processing, record cleaning, linking and ranked retrieval."""
