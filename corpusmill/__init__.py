"""A Spark-native corpus engine: blocks, chunks, lexical/dense/graph indexes and batched retrieval."""
