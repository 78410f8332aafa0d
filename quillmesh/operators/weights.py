"""Model parameters and their weighted aggregation.

Arrays stay arrays: they are cut into blocks, a task sums all clients' blocks of its rows, and one row for each block leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from quillmesh.functions.expr import seeded_uniform, squared_distance, widen_kernel

BLOCK = 1024  # elements of a block
HELD = 64 << 20  # bytes of sums that a task holds before it lets them go


def layers(df: DataFrame, array_col: str, width: int, *keys: str) -> DataFrame:
    """Cuts a flat parameter array into layers of ``width``: keys, layer, w."""
    n = F.ceil(F.size(array_col) / width).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("layer"), F.slice(F.col(array_col), i * width + 1, F.lit(width)).alias("w")))
    return df.select(*keys, F.inline(cuts))


def flat(params: DataFrame) -> DataFrame:
    """(node, n, layer, w) -> node, n, layer, pos, value."""
    return params.select("node", "n", "layer", F.posexplode("w").alias("pos", "value"))


def _block_sums(names: list[str], schema: pa.Schema):
    """Sums n and n * v by the named columns and the length of v, over all batches of a task."""

    def rows(held: dict) -> pa.RecordBatch:
        keys = [pa.array([k[i] for k in held], schema.field(name).type) for i, name in enumerate(names)]
        sums = [pa.array([x[0] for x in held.values()], pa.float64()), pa.array([x[1] for x in held.values()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([*keys, *sums], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            keys = list(zip(*(batch.column(name).to_pylist() for name in names), strict=True))
            ns, lists = batch.column("n").to_pylist(), batch.column("v")
            ends, flat = lists.offsets.to_numpy(), lists.values.fill_null(0.0).to_numpy()
            for key, n, a, b in zip(keys, ns, ends, ends[1:], strict=False):
                part = flat[a:b]
                found = held.get((*key, b - a))
                if found is None:
                    held[(*key, b - a)] = [n, n * part]
                    size += part.nbytes
                else:
                    found[0] += n
                    found[1] += n * part
            if size > HELD:
                yield rows(held)
                held, size = {}, 0
        if held:
            yield rows(held)

    return run


def _block_totals(names: list[str], schema: pa.Schema):
    """One row for each block from the sums of all tasks, which come sorted; a shorter array has no part in further elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, []

        def add(key, n, v):
            nonlocal at
            if at is None or at[0] != key:
                if at is not None:
                    out.append(at)
                at = (key, np.zeros(0), np.zeros(0))
            longer = max(len(at[1]), len(v))
            weight, total = (np.pad(x, (0, longer - len(x))) for x in at[1:])
            weight[: len(v)] += n
            total[: len(v)] += v
            at = (key, weight, total)

        def rows() -> pa.RecordBatch:
            keys = [pa.array([r[0][i] for r in out], schema.field(name).type) for i, name in enumerate(names)]
            sums = [pa.array([r[i] for r in out], pa.list_(pa.float64())) for i in (1, 2)]
            return pa.RecordBatch.from_arrays([*keys, *sums], schema=schema)

        for batch in batches:
            for *key, n, v in zip(*(batch.column(name).to_pylist() for name in names), batch.column("n").to_pylist(), batch.column("v"), strict=True):
                add(tuple(key), n, v.values.to_numpy())
            if len(out) > 1024:
                yield rows()
                out.clear()
        if at is not None:
            out.append(at)
            yield rows()

    return run


def totals(params: DataFrame, *keys: str, block: int = BLOCK) -> DataFrame:
    """(keys, n, layer, w) -> keys, layer, weights, sums: for each element the sum of n and of n * w over all rows.

    A row whose n or w is null has no part. What is shuffled is a row for each block and task, whatever the number of clients.
    """
    names = [*keys, "layer", "block"]
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / block).cast("int") - 1, F.lit(0))), lambda i: F.struct(i.alias("block"), F.slice("w", i * block + 1, F.lit(block)).alias("v")))
    rows = params.filter("n IS NOT NULL AND w IS NOT NULL").select(*keys, "layer", F.col("n").cast("double").alias("n"), F.col("w").cast("array<double>").alias("w"))
    rows = rows.select(*keys, "layer", "n", F.inline(cut))
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    kinds = {name: rows.schema[name].dataType.simpleString() for name in names}
    fields = [pa.field(name, arrow[kinds[name]]) for name in names]
    lists = pa.list_(pa.float64())
    head = ", ".join(f"{name} {kinds[name]}" for name in names)
    sums = rows.mapInArrow(_block_sums(names, pa.schema([*fields, ("n", pa.float64()), ("v", lists)])), f"{head}, n double, v array<double>")
    sums = sums.repartition(*names).sortWithinPartitions(*names)
    blocks = sums.mapInArrow(_block_totals(names, pa.schema([*fields, ("weights", lists), ("sums", lists)])), f"{head}, weights array<double>, sums array<double>")
    whole = blocks.groupBy(*keys, "layer").agg(F.array_sort(F.collect_list(F.struct("block", "weights", "sums"))).alias("b"))
    joined = lambda name: F.flatten(F.transform("b", lambda x: x[name])).alias(name)
    return whole.select(*keys, "layer", joined("weights"), joined("sums"))


def average(params: DataFrame, *keys: str, block: int = BLOCK) -> DataFrame:
    """(keys, n, layer, w) -> keys, layer, w: the mean weighted by n, element by element.

    All-zero weights give null elements, no rows give no rows, integers average as floats.
    """
    whole = params.schema["w"].dataType.elementType
    kind = "array<float>" if isinstance(whole, (ByteType, ShortType, IntegerType, LongType)) else "array<double>"
    mean = F.zip_with("sums", "weights", lambda s, n: F.try_divide(s, n)).cast(kind)
    return totals(params, *keys, block=block).select(*keys, "layer", mean.alias("w"))


def fedavg(params: DataFrame) -> DataFrame:
    """``average`` by element: layer, pos, value."""
    return average(params).select("layer", F.posexplode("w").alias("pos", "value"))


def average_but(params: DataFrame, bn_layers: DataFrame) -> DataFrame:
    """layer, w: averages all but the normalisation layers; of those, the copy of the first node by name is the placeholder."""
    bn = F.broadcast(bn_layers.select("layer").distinct())  # one row for each layer of one model
    shared = average(params.join(bn, "layer", "left_anti"))
    local = params.join(bn, "layer", "left_semi").groupBy("layer").agg(F.min_by("w", "node").cast("array<double>").alias("w"))
    return shared.unionByName(local)


def fedbn(params: DataFrame, bn_layers: DataFrame) -> DataFrame:
    """``average_but`` by element: layer, pos, value."""
    return average_but(params, bn_layers).select("layer", F.posexplode("w").alias("pos", "value"))


def assemble(flat_params: DataFrame, *keys: str) -> DataFrame:
    """Rows back to arrays in position order: keys, layer, w."""
    return flat_params.groupBy(*keys, "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("w"))


def load(local: DataFrame, shared: DataFrame, bn_layers: DataFrame) -> DataFrame:
    """What a node runs with after a round: the shared weights, but its own in the normalisation layers."""
    bn = F.broadcast(bn_layers.select("layer", F.lit(True).alias("is_bn")).distinct())
    kept = local.select("node", "layer", F.col("w").alias("own")).join(bn, "layer", "left").join(shared.select("layer", F.col("w").alias("given")), "layer", "left")
    kind = local.schema["w"].dataType  # the averages are doubles; a node gets back what it had
    return kept.select("node", "layer", F.when(F.coalesce("is_bn", F.lit(False)), F.col("own")).otherwise(F.coalesce(F.col("given").cast(kind), "own")).alias("w"))


def proximal(local: DataFrame, shared: DataFrame, mu: float) -> DataFrame:
    """node, prox: mu / 2 times the squared distance to the shared weights over all layers."""
    pairs = local.join(shared.select("layer", F.col("w").alias("g")), "layer")
    return pairs.groupBy("node").agg((F.lit(mu / 2) * F.sum(squared_distance(F.col("w"), F.col("g")))).alias("prox"))


def footprint(params: DataFrame, bytes_each: int = 4) -> DataFrame:
    return params.agg(F.sum(F.size("w")).cast("long").alias("n_params"), (F.sum(F.size("w")) * bytes_each / 1e6).alias("size_mb"))


def build_model(pretrained: DataFrame, *, first: int, known: int, channels: int, head: int, inputs: int, classes: int, area: int = 1, seed: int = 42) -> DataFrame:
    """(layer, w) of a pretrained model -> (layer, w) of one for other channels and classes.

    The first layer's kernels get further channels, the mean of the known ones. The head is new: ``classes`` times ``inputs``
    seeded numbers within 1 / sqrt(inputs); all other layers are kept.
    """
    fresh = F.transform(F.sequence(F.lit(0), F.lit(classes * inputs - 1)), lambda k: seeded_uniform(seed, k, inputs**-0.5))
    w = F.col("w").cast("array<double>")
    wider = widen_kernel(w, known, channels, area) if channels > known else w
    return pretrained.select("layer", F.when(F.col("layer") == first, wider).when(F.col("layer") == head, fresh).otherwise(w).alias("w"))
