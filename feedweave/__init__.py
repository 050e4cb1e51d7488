"""Spark-native parsing and analytics of syndication feeds."""
