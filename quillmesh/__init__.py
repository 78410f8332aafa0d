"""Spark-first engine for federated-learning data work and training-data pipelines."""
