"""Spark-first building blocks: operators."""
