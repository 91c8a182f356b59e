"""Alignment and prediction toolkit for large collections of ordered series, on Spark."""
