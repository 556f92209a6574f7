"""Spark-native analytics of Vietnamese SMS traffic; see README.md."""
