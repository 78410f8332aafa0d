"""Exact deduplication over an extendible-hash index (built-in DataFrame operations only).

1. Every row's key, a 64-bit hash of its normalised text, is written once, with the row's id.
2. Directory. The different keys are counted by prefix; the directory of key prefixes doubles until no bucket holds more
   than ``capacity`` of them, or one key alone is left.
3. Owners. Each row looks up its bucket in the directory and goes to the task that owns the bucket; an owner has a range of
   buckets. There the texts of a key are told apart by their bytes: each different text is one entry, and the entries of
   one key form a chain. Copies of very frequent keys collapse before they are dealt, so that no owner gets them all.
4. The index, one row for each entry in the order of buckets, is written to the shared folder. A row finds its entry by
   its key, in a join, and in a chain by its bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from quillmesh.llm.common import ascii_lower, only, positional, written

BROADCAST_ROWS = 1 << 21
OWNER_BYTES, MOST_BYTES, MANY_TASKS = 8 << 20, 256 << 20, 20_000  # text of a task: small while tasks are few


def _norm(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def _key(norm: Column, hash_bits: int) -> Column:
    h = F.xxhash64(norm)
    return h if hash_bits == 64 else F.shiftrightunsigned(h, 64 - hash_bits)


def _checked(df: DataFrame, n: int) -> DataFrame:
    """Broadcast where it is small by count, joined by a shuffle beyond."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def directory(keys: DataFrame, n: int, capacity: int, hash_bits: int) -> tuple[DataFrame, int]:
    """(slot, bucket, depth, position) of the directory at its final size of 2 ** bits slots, and bits.

    ``keys`` has each of the ``n`` different keys once. A bucket is named by its first slot; ``position`` is the share of
    all keys before it, so equal ranges of it are owners of equal work. Keys are counted for 3 prefix bits more than evenly
    spread keys need; these are the deepest that the directory can get.
    """
    fine = min(hash_bits, 62, max(1, math.ceil(math.log2(max(2, n / capacity))) + 3))
    slots = written(keys.groupBy(F.shiftrightunsigned("h", hash_bits - fine).alias("slot")).count(), "dedup-slots")
    depth, grown = 1, slots.withColumn("depth", F.lit(1))
    while depth < fine:
        prefix = F.shiftrightunsigned("slot", fine - depth)
        full = grown.filter(F.col("depth") == depth).groupBy(prefix.alias("bucket")).agg(F.sum("count").alias("n")).filter(F.col("n") > capacity)
        full = full.select("bucket", F.lit(depth + 1).alias("deeper"))
        if full.isEmpty():
            break
        deeper = F.when(F.col("depth") == depth, F.coalesce("deeper", "depth")).otherwise(F.col("depth"))
        grown = grown.withColumn("bucket", prefix).join(full, "bucket", "left").select("slot", "count", deeper.alias("depth"))
        grown = written(grown, "dedup-directory")
        depth += 1
    bucket = F.expr(f"shiftleft(shiftrightunsigned(slot, {fine} - depth), {fine} - depth)")
    return grown.select("slot", bucket.alias("bucket"), "depth", (F.col("slot") / float(1 << fine)).alias("position")), fine


def build_index(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, most_buckets: int = 1 << 18, hash_bits: int = 64, hot_rows: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """(keys: id, h; index: owner, bucket, depth, h, chain, chained, bytes, keep_id, group_size, text_sha256).

    ``chain`` is the position among the entries of one key, ``chained`` says that there are several; only these keep their
    ``bytes``. Beyond ``capacity * most_buckets`` different keys a bucket may hold more, so the directory stays bounded.
    """
    spark = docs.sparkSession
    norm = _norm(text_col)
    keys = docs.select(F.col(f"`{id_col}`").alias("id"), _key(norm, hash_bits).alias("h"), F.octet_length(norm).cast("long").alias("size"))
    keys = written(keys, "dedup-keys")
    counts = written(keys.groupBy("h").agg(F.count("*").alias("rows")), "dedup-counts")
    n = counts.count()
    slots, fine = directory(counts, n, max(capacity, -(-n // most_buckets)), hash_bits)
    n_slots = slots.count()
    hot = counts.filter(F.col("rows") > hot_rows).select("h")
    n_hot = hot.count()
    total = keys.agg(F.sum("size")).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, min(-(-total // OWNER_BYTES), MANY_TASKS), -(-total // MOST_BYTES))

    rows = docs.select(norm.alias("norm"), F.col(f"`{id_col}`").alias("keep_id")).withColumn("h", _key(F.col("norm"), hash_bits))
    entries = rows.withColumn("group_size", F.lit(1).cast("long"))
    if n_hot:
        copies = rows.join(_checked(hot, n_hot), "h", "left_semi").groupBy("h", "norm").agg(F.max("keep_id").alias("keep_id"), F.count("*").alias("group_size"))
        entries = entries.join(_checked(hot, n_hot), "h", "left_anti").unionByName(copies)
    slot = F.shiftrightunsigned("h", hash_bits - fine)
    dealt = entries.withColumn("slot", slot).join(_checked(slots, n_slots), "slot")
    # Four ranges of buckets to a task; a bucket has one position, that of its first slot.
    start = F.col("bucket") / float(1 << fine)
    dealt = dealt.withColumn("owner", F.floor(start * (4 * tasks)).cast("long")).repartition(tasks, "owner")
    found = dealt.groupBy("owner", "bucket", "depth", "h", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    found = found.withColumn("text_sha256", F.sha2("norm", 256))
    of_key = w.Window.partitionBy("owner", "bucket", "h")
    found = found.withColumn("chain", F.row_number().over(of_key.orderBy("text_sha256", "norm")) - 1).withColumn("chained", F.count("*").over(of_key) > 1)
    bytes_ = F.when(F.col("chained"), F.col("norm")).alias("bytes")
    index = found.select("owner", "bucket", "depth", "h", "chain", "chained", bytes_, "keep_id", "group_size", "text_sha256")
    return keys, written(index, "dedup-index")


def _lookup(docs: DataFrame, keys: DataFrame, index: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    """id, h, keep_id, group_size, text_sha256 for each row."""
    names = ("id", "h", "keep_id", "group_size", "text_sha256")
    found = keys.join(index.filter(~F.col("chained")), "h").select(*names)
    chains = index.filter("chained")
    if not chains.isEmpty():
        # Keys with several texts, a vanishing part of 64-bit keys: the bytes decide.
        rows = docs.select(F.col(f"`{id_col}`").alias("id"), _norm(text_col).alias("norm")).withColumn("h", _key(F.col("norm"), hash_bits))
        met = rows.join(chains, "h").filter(F.col("norm") == F.col("bytes"))
        found = found.unionByName(met.select(*names))
    return found


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64, **options) -> DataFrame:
    """One row for each document: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z only; null counts as empty; the largest id of a group stays. Of
    rows repeated with that same id, each is marked kept (``exact_dedup`` returns just one). A null id loses against any
    other; in a group of null ids only, keep_id is null and every row is kept. An empty table gives an empty result; other
    columns are ignored. ``options`` are those of ``build_index``.
    """
    docs = only(docs, id_col, text_col)
    keys, index = build_index(docs, id_col=id_col, text_col=text_col, hash_bits=hash_bits, **options)
    found = _lookup(docs, keys, index, id_col, text_col, hash_bits)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64, **options) -> DataFrame:
    """The documents that stay, with all their columns: one row for each distinct normalised text, that with the largest id.

    Null counts as empty; a null id loses against any other; of rows that repeat an id and its text, one stays. Texts of any
    length are compared whole. An empty table gives an empty result. Other columns stay, whatever their names.
    """
    plain, (id_, text) = positional(docs, id_col, text_col)
    keys, index = build_index(plain, id_col=id_, text_col=text, hash_bits=hash_bits, **options)
    found = _lookup(plain, keys, index, id_, text, hash_bits)
    same = (F.col("key") == F.col("h")) & F.col(id_).eqNullSafe(F.col("id"))
    clash = written(index.filter("chained").select("h").distinct(), "dedup-clash")
    clash = _checked(clash, clash.count())
    gone = found.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select("h", "id")
    gone = written(gone.join(clash, "h", "left_anti").distinct(), "dedup-gone")
    twice = keys.groupBy("h", "id").count().filter("count > 1").select("h", "id")
    # Keys with a chain, and ids that repeat within a key, need a look at the texts.
    twice = written(twice.unionByName(keys.join(clash, "h", "left_semi").select("h", "id")).distinct(), "dedup-twice")
    gone, twice = _checked(gone, gone.count()), _checked(twice, twice.count())
    kept = plain.withColumn("key", _key(_norm(text), hash_bits)).join(gone, same, "left_anti")
    apart = kept.join(twice, same, "left_semi").withColumn("norm", _norm(text))
    one = w.Window.partitionBy("key", "norm").orderBy(F.desc_nulls_last(id_))
    apart = apart.withColumn("n", F.row_number().over(one)).filter("n = 1").drop("n", "norm")
    return kept.join(twice, same, "left_anti").unionByName(apart).drop("key").toDF(*docs.columns)
