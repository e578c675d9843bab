"""Spark-native entity resolution, graph and retrieval analytics over DataFrames."""
