"""Frame sets of synchronised streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

STREAMS = ("color", "depth", "ir")


def assemble(events: DataFrame, frame_col: str, streams: tuple[str, ...] = STREAMS) -> DataFrame:
    """(frame, stream, ts, value) -> one row for each frame with the first ts of every stream; incomplete frames go."""
    first = [F.min(F.when(F.col("stream") == s, F.col("ts"))).alias(f"{s}_ts") for s in streams]
    out = events.groupBy(frame_col).agg(*first, F.count("*").alias("n_events"))
    return out.filter(F.greatest(*[F.col(f"{s}_ts").isNull().cast("int") for s in streams]) == 0)


def after_warm_up(frames: DataFrame, order_col: str, skip: int = 30, take: int = 100) -> DataFrame:
    """Frames skip+1 .. skip+take in order, with a zero-padded id. Only the first skip+take rows are ever sorted in one place."""
    head = frames.orderBy(order_col).limit(skip + take)
    n = F.row_number().over(w.Window.orderBy(order_col))
    return head.withColumn("n", n).filter(F.col("n") > skip).withColumn("frame_id", F.lpad((F.col("n") - skip - 1).cast("string"), 5, "0")).drop("n")


def depth_range(depth: Column) -> tuple[Column, Column]:
    """Smallest and largest positive depth; 0 where there is none."""
    positive = F.when(depth > 0, depth)
    return F.coalesce(F.min(positive), F.lit(0.0)), F.coalesce(F.max(positive), F.lit(0.0))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Extension: each left row with the last right value at or before it. One union and one window, so one shuffle by key."""
    both = left.select(key, ts, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"), *[F.col(c) for c in left.columns if c not in (key, ts)])
    both = both.unionByName(right.select(key, ts, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True)
    last = F.last("_v", ignorenulls=True).over(w.Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(w.Window.unboundedPreceding, 0))
    return both.withColumn(value, last).filter("_side = 1").drop("_side", "_v")


def as_of_within(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tolerance_s: int) -> DataFrame:
    """Each left row with the last right value at or before it, no older than the tolerance; null where there is none.

    Time is cut into ranges as long as the tolerance: what a row can meet is in its own range or in the one before, whose
    last value is carried over. So a key of any number of rows is split by time, and no task sorts it whole.
    """
    step = tolerance_s * 1_000_000
    place = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / step)
    own = [c for c in left.columns if c not in (key, ts)]
    seen = right.filter(F.col(ts).isNotNull()).select(key, ts, F.struct(F.col(ts).alias("at"), F.col(value).alias("value")).alias("_v"), place.alias("_p"))
    last = seen.groupBy(key, "_p").agg(F.max_by("_v", ts).alias("_v")).select(key, F.col("_v.at").alias(ts), "_v", (F.col("_p") + 1).alias("_p"))
    both = left.select(key, ts, place.alias("_p"), F.lit(1).alias("_side"), F.struct(*own).alias("_row"))
    both = both.unionByName(seen.unionByName(last).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    by = w.Window.partitionBy(key, "_p").orderBy(ts, "_side").rowsBetween(w.Window.unboundedPreceding, 0)
    met = both.withColumn("_m", F.last("_v", ignorenulls=True).over(by)).filter("_side = 1")
    age = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_m.at").cast("timestamp"))
    return met.select(key, ts, "_row.*", F.when(age <= step, F.col("_m.value")).alias(value))
