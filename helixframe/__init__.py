"""Spark-native analytics over sequence-storage dataflows."""
