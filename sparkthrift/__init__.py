"""Spark-native analytics over LLM request traffic."""
