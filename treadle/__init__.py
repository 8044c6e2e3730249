"""Ranked path search and access analytics on Spark."""
