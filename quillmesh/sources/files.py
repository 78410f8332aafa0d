"""File sources: image folders, log texts, run results and configuration."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as w

from quillmesh.functions.expr import class_of_path, is_image

ROUND = "array<struct<round: int, loss: double>>"
VALUE = "map<string, array<struct<round: int, value: double>>>"
EPOCH = "struct<epoch: int, train_loss: double, val_loss: double, val_accuracy: double, epoch_time_s: double>"
TEST = "struct<test_loss: double, test_accuracy: double>"
RUN = f"strategy string, num_rounds int, min_clients int, seed int, total_time_s double, timestamp string, losses_distributed {ROUND}, metrics_distributed {VALUE}"
BASELINE = (
    "experiment string, hostname string, node_name string, data_dir string, data_dirs array<string>, epochs int, batch_size int, lr double, seed int, total_time_s double, "
    f"final_test_loss double, final_test_accuracy double, per_node_test map<string, {TEST}>, cross_eval map<string, {TEST}>, train_class_distribution map<string, bigint>, "
    f"history array<{EPOCH}>, fl_round_equivalents map<string, {EPOCH}>, timestamp string"
)
NODE = f"struct<final_test_accuracy: double, final_test_loss: double, cross_eval: map<string, {TEST}>>"
BATCH = f"experiment string, seed int, epochs int, total_time_s double, nodes map<string, {NODE}>, mean_test_accuracy double, timestamp string"


def images(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """path, class, label of every image under ``folder``; files of other classes or types are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}").load(folder)
    if not content:
        found = found.drop("content")
    kind = class_of_path(F.col("path"))
    return found.withColumn("class", kind).filter(is_image(F.col("path")) & kind.isNotNull()).withColumn("label", (F.col("class") == "Fire").cast("int"))


def split_members(spark: SparkSession, path: str, dist: str, node: str, split: str) -> DataFrame:
    """One split of a written partitioning; the three filters prune folders."""
    return spark.read.parquet(path).filter((F.col("dist") == dist) & (F.col("node") == node) & (F.col("split") == split))


def logs(spark: SparkSession, path: str) -> DataFrame:
    """Whole log files: path, value."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def numbered_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files of any size: path, line_num (0-based, blank lines count), value.

    Files are read in splits, wherever those cut them. Rows of a split are consecutive, so a line's number is its place in the
    split plus the lines of the file's splits before, of which there is a count each.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    sizes = rows.groupBy("path", "split").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = w.Window.partitionBy("path").orderBy("split").rowsBetween(w.Window.unboundedPreceding, -1)
    starts = sizes.select("path", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    text = F.regexp_replace("value", "\r$", "")
    return rows.join(starts, ["path", "split"]).select("path", (F.col("start") + F.col("row") - F.col("first")).alias("line_num"), text.alias("value"))


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """Federated results, old files and new: a missing seed is taken from the path, then the default 42."""
    raw = spark.read.schema(RUN).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    seed = F.coalesce("seed", F.regexp_extract("path", r"seed(\d+)", 1).try_cast("int"), F.lit(42))
    parent = F.element_at(F.split("path", "/"), -2)
    dist = F.when(parent.rlike("non_?iid"), "non_iid").otherwise("iid")
    return raw.withColumns({"seed": seed, "run": parent, "dist": dist})


def run_rounds(results: DataFrame) -> DataFrame:
    """run, strategy, dist, seed, round, loss, accuracy."""
    keys = ("run", "strategy", "dist", "seed")
    given = F.coalesce(F.try_element_at("metrics_distributed", F.lit("accuracy")), F.array().cast("array<struct<round: int, value: double>>"))
    accuracies = F.map_from_entries(F.transform(given, lambda x: F.struct(x["round"], x["value"])))
    rounds = results.withColumn("acc", accuracies).select(*keys, F.explode("losses_distributed").alias("l"), "acc")
    return rounds.select(*keys, "l.round", "l.loss", F.try_element_at("acc", F.col("l.round")).alias("accuracy"))


def baseline_results(spark: SparkSession, path: str, batch: bool = False) -> DataFrame:
    return spark.read.schema(BATCH if batch else BASELINE).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """path, key, value of YAML files: keys of nested mappings and lists are joined by dots, values are JSON text."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        def leaves(at: str, x):
            inner = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else None
            if inner is None:
                yield at, json.dumps(x, default=str)
            for k, v in inner or ():
                yield from leaves(f"{at}.{k}" if at else str(k), v)

        for pdf in frames:
            found = [(p, *leaf) for p, text in zip(pdf["path"], pdf["value"], strict=True) for leaf in leaves("", yaml.safe_load(text) or {})]
            yield pd.DataFrame(found, columns=["path", "key", "value"])

    return logs(spark, path).mapInPandas(rows, "path string, key string, value string")


def save_weights(params: DataFrame, path: str, name: str) -> int:
    """(node, layer, w) as a new version of a model; returns its number.

    The version's folder is written whole, then its number is claimed by creating a file that must not exist: readers see a
    version once that is there, never half a model. Of two writers with one number, one gets the next.
    """
    spark = params.sparkSession
    fresh = f"{path}/model={name}/data/{uuid.uuid4().hex}"
    params.select("node", "layer", "w").write.parquet(fresh)
    jvm = spark._jvm
    number = max(weight_versions(spark, path, name), default=0) + 1
    while True:
        commit = jvm.org.apache.hadoop.fs.Path(f"{path}/model={name}/commits/{number:010d}")
        fs = commit.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        try:
            out = fs.create(commit, False)
        except Exception as e:
            if not fs.exists(commit):
                raise e
            number += 1
            continue
        out.write(bytearray(fresh.rsplit("/", 1)[1].encode()))
        out.close()
        return number


def weight_versions(spark: SparkSession, path: str, name: str) -> list[int]:
    """The committed versions of a model, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/model={name}/commits")
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(folder)) if fs.exists(folder) else []


def load_weights(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """node, layer, w of a version, the last if none is named."""
    number = version or max(weight_versions(spark, path, name), default=0)
    data = spark.read.text(f"{path}/model={name}/commits/{number:010d}").first()[0]
    return spark.read.parquet(f"{path}/model={name}/data/{data}").select("node", "layer", "w")


def write_summary(df: DataFrame, path: str, kind: str = "json") -> None:
    """Results as JSON lines or CSV with a header; null fields are left out of JSON."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
