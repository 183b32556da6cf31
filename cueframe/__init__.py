"""Timed-text analytics on Spark."""
