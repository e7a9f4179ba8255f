"""Sensitive-data analytics on Spark."""
