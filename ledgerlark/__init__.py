"""Spark-native document analytics: operators, sources, functions, plans and streaming."""
