"""Inventory, stratified and skewed partitioning, and deterministic splits of labelled samples.

Positions inside a shuffled class are computed without sorting a class in one task: counts for each prefix of the order key
give offsets, and rows are numbered inside their prefix only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from quillmesh.functions.expr import base_name, half_even, order_key

PREFIX = 5  # hex digits: a million ranges of each group at most, so a range of 1e12 rows has a million


def ranked(df: DataFrame, groups: list[str], key: Column, id_col: str) -> DataFrame:
    """``df`` with ``pos`` (0-based, by key then id inside the group) and ``size`` of the group, both long."""
    df = df.withColumn("_k", key).withColumn("_p", F.substring("_k", 1, PREFIX))
    before = w.Window.partitionBy(*groups).orderBy("_p").rowsBetween(w.Window.unboundedPreceding, -1)
    starts = df.groupBy(*groups, "_p").count().select(
        *groups, "_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"), F.sum("count").over(w.Window.partitionBy(*groups)).alias("size")
    )
    here = F.row_number().over(w.Window.partitionBy(*groups, "_p").orderBy("_k", id_col)) - 1
    return df.withColumn("_n", here).join(starts, [*groups, "_p"]).withColumn("pos", (F.col("_start") + F.col("_n")).cast("long")).drop("_k", "_p", "_n", "_start")


def bucket(pos: Column, size: Column, n: int) -> Column:
    """0-based bucket of n balanced ones; the first ``size % n`` get one more."""
    small, extra = F.floor(size / n), size % n
    return F.when(pos < extra * (small + 1), F.floor(pos / (small + 1))).otherwise(extra + F.floor((pos - extra * (small + 1)) / F.greatest(small, F.lit(1)))).cast("int")


def node_name(k: Column) -> Column:
    return F.concat(F.lit("node_"), F.char(F.lit(97) + k))


def iid(samples: DataFrame, nodes: int = 3, seed: int = 42) -> DataFrame:
    """(id, class) -> id, class, node: every class is dealt evenly."""
    r = ranked(samples.select("id", "class"), ["class"], order_key(seed, F.col("id")), "id")
    return r.select("id", "class", node_name(bucket(F.col("pos"), F.col("size"), nodes)).alias("node"))


def skew_limits(samples: DataFrame, nodes: int) -> DataFrame:
    """class, first, middle: how many of a shuffled class go to the first node, and to those between it and the last."""
    per = F.floor((F.col("fires") + F.col("others")) / nodes)
    most = F.floor(per * F.lit(0.7 if nodes == 2 else 0.8))
    sizes = samples.agg(F.count_if(F.col("class") == "Fire").alias("fires"), F.count_if(F.col("class") == "No_Fire").alias("others"))
    leaning = sizes.withColumns({"per": per, "lean": F.least(most, "fires")})
    leaning = leaning.withColumn("back", F.least(most, F.col("others") - (F.col("per") - F.col("lean"))))

    def limits(name: str, size: str, first: Column, last: Column) -> Column:
        left = F.col(size) - first
        return F.struct(F.lit(name).alias("class"), first.alias("first"), (left if nodes == 2 else F.greatest(F.lit(0), left - last)).alias("middle"))

    lean, back, per = F.col("lean"), F.col("back"), F.col("per")
    return leaning.select(F.inline(F.array(limits("Fire", "fires", lean, per - back), limits("No_Fire", "others", per - lean, back))))


def label_skew(samples: DataFrame, nodes: int = 3, seed: int = 42) -> DataFrame:
    """(id, class) -> id, class, node: the first node holds 70 % (of two nodes) or 80 % Fire, the last of three or more the reverse.

    The nodes between share what remains evenly. Where too few samples remain they get none, so nodes are disjoint and
    complete for any class sizes.
    """
    r = ranked(samples.select("id", "class"), ["class"], order_key(f"skew:{seed}", F.col("id")), "id")
    r = r.join(F.broadcast(skew_limits(samples, nodes)), "class")  # one row for each class
    between = 1 + bucket(F.col("pos") - F.col("first"), F.col("middle"), max(1, nodes - 2))
    k = F.when(F.col("pos") < F.col("first"), 0).when((F.col("pos") < F.col("first") + F.col("middle")) | F.lit(nodes == 2), between).otherwise(nodes - 1)
    return r.select("id", "class", node_name(F.when(F.lit(nodes == 2), F.least(k, F.lit(1))).otherwise(k)).alias("node"))


def split(parts: DataFrame, seed: int = 42, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """(id, class, node) -> with ``split``: train, val, test by position inside (node, class); cuts are floors of double products."""
    r = ranked(parts, ["node", "class"], order_key(f"split:{seed}", F.col("id")), "id")
    cut = lambda x: F.floor(F.col("size") * F.lit(float(x)))
    name = F.when(F.col("pos") < cut(train), "train").when(F.col("pos") < cut(train + val), "val").otherwise("test")
    return r.select("id", "class", "node", name.alias("split"))


def statistics(splits: DataFrame) -> DataFrame:
    """(dist, node, split, class) rows -> dist, node, split, fire, nofire, total, fire_ratio; absent classes count 0."""
    out = splits.groupBy("dist", "node", "split").agg(F.count_if(F.col("class") == "Fire").alias("fire"), F.count_if(F.col("class") == "No_Fire").alias("nofire"))
    total = F.col("fire") + F.col("nofire")
    return out.select("dist", "node", "split", "fire", "nofire", total.alias("total"), half_even(F.col("fire") / F.greatest(total, F.lit(1)), 3).alias("fire_ratio"))


def inventory(samples: DataFrame) -> DataFrame:
    """class, n of both classes; an absent class has 0."""
    sizes = samples.agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("Fire", "No_Fire")])
    return sizes.select(F.inline(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in ("Fire", "No_Fire")])))


def by_base_name(members: DataFrame, path_col: str, *keys: str) -> DataFrame:
    """One row for each file name within ``keys``: of files of one name in different folders the path that sorts last stays."""
    last = members.groupBy(*keys, base_name(F.col(path_col)).alias("base_name")).agg(F.max(path_col).alias(path_col))
    return last.select(*keys, "base_name", path_col)


def write_splits(splits: DataFrame, path: str) -> None:
    """Partitioned Parquet; overwriting replaces what an earlier split left, so two runs never mix. Where rows have a ``path``, a name is written once."""
    if "path" in splits.columns:
        splits = splits.join(by_base_name(splits, "path", "dist", "node", "split", "class").drop("base_name"), ["dist", "node", "split", "class", "path"], "left_semi")
    splits.write.mode("overwrite").partitionBy("dist", "node", "split", "class").parquet(path)
