"""Spark-native encounter analytics: DataFrame operators over partitioned service records."""
