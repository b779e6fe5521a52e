"""Spark-native document retrieval and answerability analytics."""
