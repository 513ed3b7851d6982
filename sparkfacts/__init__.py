"""Spark-native engine for public-record facts, competition results and corpus work."""
