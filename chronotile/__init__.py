"""Comparison of two images of one place, as relational work on Spark."""
