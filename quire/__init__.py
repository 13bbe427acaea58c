"""Spark-native analytics over corpora of research papers."""
