"""Cohort and time-to-event analytics as PySpark DataFrame operations."""
