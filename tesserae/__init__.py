"""Spark-first detection and decoding of square fiducial markers, and the analytics around it."""
