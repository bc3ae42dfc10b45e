"""Ordered gesture and symbol streams on Spark: from landmark frames to text."""
