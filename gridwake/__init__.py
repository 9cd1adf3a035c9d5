"""Spark-native analytics for irregular, multi-signal event streams grouped by entity."""
