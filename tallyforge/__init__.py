"""Spark-native analytics for advertising delivery, store orders and decision evidence."""
