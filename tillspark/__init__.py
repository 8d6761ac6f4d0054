"""Retail data jobs on Spark: functions from DataFrame to DataFrame."""
