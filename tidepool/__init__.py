"""Spark-native preparation and analysis of point-annotated image data and training text."""
