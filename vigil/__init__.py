"""Spark-native analytics over short alert posts and their reference data."""
