"""How the given tables stand in for the engine's own inputs: images, weights, client metrics, logs, frames, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import partition, weights
from quillmesh.sources.shared import stored
from quillmesh.sources.tables import table

WIDTH = 8  # elements of a layer; odd layers are normalisation layers


def samples(spark: SparkSession, d: str) -> DataFrame:
    """id, class."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, "Fire").otherwise("No_Fire").alias("class"))


def toxic_samples(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select("doc_id")
    return table(spark, d, "labels").join(ids, "doc_id").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "Fire").otherwise("No_Fire").alias("class"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """id, node, split, label, x, ord: samples dealt evenly over three nodes, numbered once and stored."""
    splits = partition.split(partition.iid(samples(spark, d))).select("id", "node", "split")
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return stored(splits.join(vec, "id").withColumn("ord", F.md5(F.concat_ws(":", F.lit("order"), F.col("id").cast("string")))))


def params(spark: SparkSession, d: str) -> DataFrame:
    """node, n, layer, w: every vector is the parameters of a client."""
    v = table(spark, d, "embeddings").select(F.format_string("%08d", "vec_id").alias("node"), (F.col("label") + 1).alias("n"), "embedding")
    return weights.layers(v, "embedding", WIDTH, "node", "n")


def bn_layers(spark: SparkSession, d: str) -> DataFrame:
    return params(spark, d).select("layer").distinct().filter(F.col("layer") % 2 == 1)


def client_metrics(spark: SparkSession, d: str) -> DataFrame:
    """node, round, num_examples, accuracy, loss."""
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 3).alias("node"), F.col("l_linenumber").alias("round"), F.col("l_quantity").alias("num_examples"), (1 - F.col("l_discount")).alias("accuracy"), F.col("l_tax").alias("loss")
    )


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """event_id, ts, value: a power log line for each event."""
    return as_log_lines(table(spark, d, "events"))


def as_log_lines(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", F.regexp_extract("props", r"(\d+)", 1).try_cast("int"))
    return e.select(
        "event_id", "ts",
        F.expr("""concat('RAM ', 1000 + k * 10, '/7620MB SWAP ', k, '/3810MB CPU [', k % 100, '%@1510,', if(k % 3 = 0, 'off', concat(k % 50, '%@1344')), ',0%@729] GR3D_FREQ ', k % 100,
          '% cpu@', 40 + k % 20, '.5C gpu@', 38 + k % 20, '.0C soc2@41.5C tj@', 42 + k % 20, '.5C GPU ', 1000 + k * 3, '/', 1000 + k * 2, ' CPU ', 500 + k, '/500',
          if(k % 2 = 0, concat(' SOC ', 700 + k, '/700'), ''))""").alias("value"),
    )


def stream_kind(event_type: Column) -> Column:
    """Which camera stream an event type stands for; all five types do."""
    return F.when(event_type.isin("view", "purchase"), "color").when(event_type.isin("click", "signup"), "depth").when(event_type == "error", "ir")


def frame_events(spark: SparkSession, d: str) -> DataFrame:
    """frame, stream, ts, value: an hour is a frame."""
    kind = stream_kind(F.col("event_type")).alias("stream")
    return table(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("frame"), kind, "ts", "value").filter("stream IS NOT NULL")


def client_messages(spark: SparkSession, d: str) -> DataFrame:
    """node, round, layer, is_local, given, moved, n: each of three nodes gets a message for each layer in each of three rounds.

    A vector stands for a client's change; what is given is the mean over all nodes, what moved is the node's own mean.
    """
    v = table(spark, d, "embeddings").select((F.col("vec_id") % 3).alias("node"), (F.floor(F.col("vec_id") / 3) % 3 + 1).cast("int").alias("round"), F.posexplode("embedding").alias("at", "v"))
    mean = v.groupBy("node", "round", "at").agg(F.avg(F.col("v").cast("double")).alias("moved"), F.count("*").alias("n"))
    given = v.groupBy("round", "at").agg(F.avg(F.col("v").cast("double")).alias("given"))
    layer, pos = F.floor(F.col("at") / WIDTH).cast("int"), F.col("at") % WIDTH
    rows = mean.join(given, ["round", "at"]).groupBy("node", "round", layer.alias("layer")).agg(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), "given", "moved"))).alias("e"), F.max("n").alias("n"))
    take = lambda name: F.transform("e", lambda x: x[name]).alias(name)
    return rows.select("node", "round", "layer", (F.col("layer") % 2 == 1).alias("is_local"), take("given"), take("moved"), "n")


def first_parameters(spark: SparkSession, d: str) -> DataFrame:
    """node, layer, w: the first vector of each of three nodes."""
    v = table(spark, d, "embeddings").filter("vec_id < 3").select(F.col("vec_id").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return weights.layers(v, "x", WIDTH, "node")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """run, seed, round, accuracy, minutes: the months of the year deal the orders to three rounds."""
    o = table(spark, d, "orders").withColumn("round", (F.month("o_orderdate") - 1) % 3 + 1)
    return o.groupBy(F.col("o_orderpriority").alias("run"), (F.col("o_custkey") % 3).alias("seed"), "round").agg(
        (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("accuracy"), (F.avg("o_totalprice") / 60).alias("minutes")
    )
