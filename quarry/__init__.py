"""Spark-native analytics over functional-language intermediate representations, and training-data operators."""
