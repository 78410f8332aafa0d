"""Metric aggregation over clients and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted(value: Column, n: Column) -> Column:
    """sum(n * value) / sum(n); null where the weights sum to 0."""
    return F.try_divide(F.sum(n * value), F.sum(n))


def aggregate_round(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, num_examples, accuracy, loss) -> keys, accuracy, loss, num_examples."""
    n = F.col("num_examples")
    return results.groupBy(*keys).agg(weighted(F.col("accuracy"), n).alias("accuracy"), weighted(F.col("loss"), n).alias("loss"), F.sum(n).alias("num_examples"))


def ready(results: DataFrame, min_clients: int) -> DataFrame:
    """Rounds in which enough different clients took part."""
    return results.groupBy("round").agg(F.count_distinct("node").alias("clients")).filter(F.col("clients") >= min_clients).select("round", "clients")


def evaluation(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, pred[, loss]) -> keys, num_examples, correct, accuracy."""
    n = F.count("*")
    correct = F.count_if(F.col("pred") == F.col("label"))
    return scored.groupBy(*keys).agg(n.alias("num_examples"), correct.alias("correct"), (correct / F.greatest(n, F.lit(1))).alias("accuracy"))
