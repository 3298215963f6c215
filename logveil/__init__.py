"""Spark-native pseudonymisation of logs and analytics over the result."""
