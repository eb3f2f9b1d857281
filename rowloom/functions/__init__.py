"""Spark-first building blocks: functions."""
