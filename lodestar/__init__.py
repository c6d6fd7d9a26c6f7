"""Spark-native compressed vector search: encode, index, scan and evaluate embeddings as DataFrames."""
