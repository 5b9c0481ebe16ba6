"""Spark-native analytics on restriction-tag anchors."""
