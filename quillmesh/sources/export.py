"""Nested result documents, for readers of the recorded JSON shapes. Results are small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from quillmesh.functions.expr import half_even


def nested_statistics(stats: DataFrame) -> DataFrame:
    """One row: dist -> node -> split -> counts, as nested maps."""
    leaf = F.struct("fire", "nofire", "total", "fire_ratio")
    by_split = stats.groupBy("dist", "node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", leaf.alias("s"))))).alias("m"))
    by_node = by_split.groupBy("dist").agg(F.map_from_arrays(F.collect_list("node"), F.collect_list("m")).alias("m"))
    return by_node.agg(F.map_from_arrays(F.collect_list("dist"), F.collect_list("m")).alias("split_stats"))


def baseline_document(finals: DataFrame) -> DataFrame:
    """(run, seed, accuracy, minutes) -> one row for each run in the recorded shape: total time, mean accuracy, nodes by name.

    Times are rounded to 1 digit, accuracies to 6.
    """
    leaf = F.struct(half_even(F.col("accuracy"), 6).alias("final_test_accuracy"), half_even(F.col("minutes") * 60, 1).alias("total_time_s"))
    entry = F.struct(F.concat(F.lit("node_"), F.char(F.lit(97) + F.col("seed").cast("int"))).alias("node"), leaf.alias("result"))
    out = finals.groupBy("run").agg(
        half_even(F.sum("minutes") * 60, 1).alias("total_time_s"),
        half_even(F.avg("accuracy"), 6).alias("mean_test_accuracy"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("nodes"),
    )
    return out.select(F.col("run").alias("experiment"), "total_time_s", "nodes", "mean_test_accuracy")


def run_document(rounds: DataFrame) -> DataFrame:
    """(run, round, loss, accuracy) -> run, losses_distributed, metrics_distributed with rounds renumbered from 1 by position."""
    n = F.row_number().over(w.Window.partitionBy("run").orderBy("round"))
    r = rounds.withColumn("position", n)
    loss, acc = F.struct(F.col("position").alias("round"), "loss"), F.struct(F.col("position").alias("round"), F.col("accuracy").alias("value"))
    accuracies = F.create_map(F.lit("accuracy"), F.array_sort(F.collect_list(acc)))
    return r.groupBy("run").agg(F.array_sort(F.collect_list(loss)).alias("losses_distributed"), accuracies.alias("metrics_distributed"))
