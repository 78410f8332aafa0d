"""Exact n-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of ``percent`` or more.

1. A pass over the texts turns each into its set of shingle hashes. Equal sets are one class from here on.
2. Blocks. Linked sets share a shingle among the first |A| - ceil(t |A|) + 1 in any order that is the same for all. The
   order used here starts with a fixed slice of all shingles, the rarest first, so a text that shares little meets nobody;
   shingles that a sample shows to be very common come last, so they are hardly ever looked up. Classes that meet, directly
   or over others, form a block; no link leaves a block.
3. A block over the bounds is cut by size into bands (a link never skips a band) and each band into chunks; a tile is a
   chunk with itself, or with another chunk of its band or of the next.
4. A task joins a tile with signature trees: leaves of similar sets, nodes with the OR of their token bitmaps and their
   range of set sizes. A dual traversal starts from the pair (root, root) and drops node pairs whose sizes or greatest
   possible overlap rule out a link; the sets of leaf pairs that are left are compared, all of them.

Every link between different sets is found. A tile gives, for each set, how many documents it is linked with and one set of
its component, so what leaves a task grows with its sets and not with their links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from quillmesh.llm.common import only, positional, written
from quillmesh.llm.components import components

SPACES = (9, 10, 11, 12, 13, 32)
STEP = np.uint64(0x9E3779B97F4A7C15)
SLICE_OF, SLICE = 32, 12  # shingles whose hash modulo 32 is below 12 come first in the order
FANOUT, LEAF = 8, 16
BROADCAST_ROWS = 1_000_000
MOST_CHUNK = 8  # times the tokens of a small block that a chunk of a large one may have, and four times as many sets
SAMPLE, COMMON, MOST_COMMON = 64, 16, 1 << 20  # a shingle in 16 of the texts of every 64th is common; at most 2**20 are


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (fixed multipliers of the public-domain murmur family)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _byte_values() -> np.ndarray:
    values = _mix(np.arange(1, 257, dtype=np.uint64) * STEP)
    values[65:91] = values[97:123]  # A-Z count as a-z
    return values


_VALUES, _IS_SPACE = _byte_values(), np.isin(np.arange(256), SPACES)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and its inverse modulo 2**64, for i below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size, back = max(n, 1 << 16), pow(int(STEP), -1, 1 << 64)
        tables = []
        for base in (STEP, np.uint64(back)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of fewer words, the whole sequence is one; of none, empty."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_VALUES[raw] * up[: len(raw)], dtype=np.uint64)))
    word = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    k = min(size, len(word))
    out = np.full(len(word) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = out * STEP + word[j : len(word) - k + 1 + j]
    return np.unique(_mix(out))


def _fingerprint(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _prefix(tokens: np.ndarray, p: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles among which the first ``p`` of the order are, and those of the first ``p`` that are common.

    All of the slice, if these are enough; otherwise exactly the first ``p``, the common ones last.
    """
    often = np.zeros(len(tokens), dtype=bool)
    if len(common):
        at = np.searchsorted(common, tokens)
        often = common[np.minimum(at, len(common) - 1)] == tokens
    rare = tokens[~often]
    sliced = rare % np.uint64(SLICE_OF) < SLICE
    first = rare[sliced]
    if len(first) < p:
        first = np.concatenate((first, rare[~sliced][: p - len(first)]))
    return first, tokens[often][: max(0, p - len(first))]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    lengths = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(parts).view(np.int64)))


SKETCH = "row long, doc_id long, text_key long, n long, fp binary, prefix int, first array<long>, common array<long>"


def _sketch_task(size: int, percent: int, common: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            ns, fps, prefixes, firsts, oftens = [], [], [], [], []
            for text in batch.column(2):
                t = shingle_set(text.as_py(), size)
                n = len(t)
                p = n - -(-percent * n // 100) + 1 if n else 0
                first, often = _prefix(t, p, common.value)
                ns.append(n)
                fps.append(_fingerprint(t))
                prefixes.append(p)
                firsts.append(first)
                oftens.append(often)
            rows = pa.array(range(row, row + len(ns)), pa.int64())
            arrays = [rows, batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(fps, pa.binary())]
            arrays += [pa.array(prefixes, pa.int32()), _lists(firsts), _lists(oftens)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "text_key", "n", "fp", "prefix", "first", "common"])
            row += len(ns)

    return run


def _token_task(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                tokens = shingle_set(text.as_py(), size)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64))], names=["token"])

    return run


def common_shingles(rows: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of shingles that occur in ``COMMON`` or more of the distinct texts of a sample, ``MOST_COMMON`` at most.

    They only shape the order, so which texts are in the sample changes no link. The bound holds by arithmetic: fewer than
    2**20 shingles can have more than a 2**20th of all occurrences.
    """
    texts = rows.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = written(texts.mapInArrow(_token_task(size), "token long").groupBy("token").count().filter(F.col("count") > 1), "ngram-sampled")
    total = counts.agg(F.sum("count")).first()[0] or 0
    found = counts.filter(F.col("count") >= max(COMMON, total // MOST_COMMON + 1)).select("token").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _set_task(size: int):
    schema = pa.schema([("fp", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t.as_py(), size) for t in batch.column(0)[at : at + 512]]
                yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(t) for t in sets], pa.binary()), pa.array([t.tobytes() for t in sets], pa.binary())], schema=schema)

    return run


class Tree:
    """A signature tree over sets, given as bitmaps and sizes in an order that keeps similar sets together; a node is a range of them."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.n = bits, sizes
        self.levels: list[tuple[np.ndarray, ...]] = []
        edges = np.arange(0, len(sizes), LEAF)
        self._level(edges, np.append(edges[1:], len(sizes)), bits, sizes, sizes, edges)
        while len(self.levels[-1][0]) > 1:
            first, last, ors, low, high = self.levels[-1]
            cut = np.arange(0, len(first), FANOUT)
            self._level(first[cut], last[np.minimum(cut + FANOUT, len(first)) - 1], ors, low, high, cut)

    def _level(self, first, last, ors, low, high, cut):
        signature = np.bitwise_or.reduceat(ors, cut, axis=0)
        self.levels.append((first, last, signature, np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def children(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0])))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bit for each token that lies in more than one of the sets: the bits two sets have in common are their overlap."""
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    bit = (np.cumsum(shared) - 1)[number]
    width = max(1, -(-int(shared.sum()) // 64))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = shared[number]
    at = owner[keep] * width + (bit[keep] >> 6)
    out = np.zeros(len(sets) * width, dtype=np.uint64)
    np.bitwise_or.at(out, at, np.uint64(1) << (bit[keep] & 63).astype(np.uint64))
    return out.reshape(len(sets), width)


def dual_join(x: Tree, y: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All links (i of x, j of y); of a tree with itself those with i < j."""
    same, left, right = x is y, [], []
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        lx, i, ly, j = stack.pop()
        fx, tx, ox, lowx, highx = (c[i] for c in x.levels[lx])
        fy, ty, oy, lowy, highy = (c[j] for c in y.levels[ly])
        if 100 * highx < percent * lowy or 100 * highy < percent * lowx:
            continue
        if (100 + percent) * int(np.bitwise_count(ox & oy).sum()) < percent * int(lowx + lowy):
            continue
        if lx or ly:
            # The higher node is opened; of two of one height, both are.
            kids_x = x.children(lx, i) if lx and lx >= ly else None
            kids_y = y.children(ly, j) if ly and ly >= lx else None
            down = (lx - (kids_x is not None), ly - (kids_y is not None))
            pairs = [(a, b) for a in (kids_x or [i]) for b in (kids_y or [j])]
            stack += [(down[0], a, down[1], b) for a, b in pairs if not (same and a > b)]
            continue
        overlap = np.bitwise_count(x.bits[fx:tx, None] & y.bits[None, fy:ty]).sum(axis=2, dtype=np.int64)
        link = (100 + percent) * overlap >= percent * (x.n[fx:tx, None] + y.n[None, fy:ty])
        a, b = np.nonzero(np.triu(link, 1) if same and i == j else link)
        left.append(a + fx)
        right.append(b + fy)
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _leads(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` sets the first one of its component under the links (i, j)."""
    lead = np.arange(n)
    while True:
        least = np.minimum(lead[i], lead[j])
        new = lead.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == lead).all():
            return lead
        lead = new


def join_tile(sets: list[np.ndarray], docs: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set of a tile: the documents of the sets it is linked with, and the place of a set of its component.

    Sets of side 0 are joined in themselves, those of side 1 with those of side 2. ``docs``: documents of each set's class.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    # Sets alike in size and in their smallest hashes become neighbours in a leaf.
    order = np.lexsort((np.array([s[0] for s in sets], dtype=np.uint64), np.log(sizes) // 0.15))
    bits = bitmaps(sets)
    parts = [order[side[order] == k] for k in (0, 1, 2)]
    trees = [Tree(bits[part], sizes[part]) if len(part) else None for part in parts]
    links, lead = np.zeros(len(sets), dtype=np.int64), np.arange(len(sets))
    if trees[0] is not None:
        x, y, at_x, at_y = trees[0], trees[0], parts[0], parts[0]
    elif trees[1] is not None and trees[2] is not None:
        x, y, at_x, at_y = trees[1], trees[2], parts[1], parts[2]
    else:
        return links, lead
    i, j = dual_join(x, y, percent)
    i, j = at_x[i], at_y[j]
    np.add.at(links, i, docs[j])
    np.add.at(links, j, docs[i])
    return links, _leads(len(sets), i, j)


def _tile_task(percent: int):
    """Joins the tiles of a partition one after the other; rows come sorted by tile."""

    def joined(tile: dict[int, tuple]) -> pa.RecordBatch:
        rows = np.array(list(tile), dtype=np.int64)
        side, docs = (np.array([v[k] for v in tile.values()], dtype=np.int64) for k in (0, 1))
        links, lead = join_tile([np.frombuffer(v[2], dtype=np.uint64) for v in tile.values()], docs, side, percent)
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(rows[hit]), pa.array(links[hit]), pa.array(rows[lead][hit])], names=["row", "links", "lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tile = None, {}
        for batch in batches:
            names, rows, sides, docs = (batch.column(k).to_pylist() for k in range(4))
            for k, tokens in enumerate(batch.column(4)):
                if names[k] != name:
                    if tile:
                        yield joined(tile)
                    name, tile = names[k], {}
                tile[rows[k]] = (sides[k], docs[k], tokens.as_py())
        if tile:
            yield joined(tile)

    return run


def _checked(df: DataFrame, n: int) -> DataFrame:
    """Broadcast where it is small by count, joined by a shuffle beyond."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _tiles(held: DataFrame, percent: int, chunk_docs: int, chunk_tokens: int) -> DataFrame:
    """``held`` (row, root, n, docs, tokens), each set once for each tile that it is in: adds tile and side."""
    load = lambda: F.greatest(F.sum("n") / chunk_tokens, F.count("*") / chunk_docs)
    large = held.groupBy("root").agg(load().alias("load")).filter("load > 1").select("root")
    large = written(large, "ngram-large")
    n_large = large.count()
    whole = held.join(_checked(large, n_large), "root", "left_anti").withColumn("tile", F.col("root").cast("string")).withColumn("side", F.lit(0))
    names = ("tile", "row", "side", "docs", "tokens")
    if not n_large:
        return whole.select(*names)
    # Sizes that can link differ by at most one band; bands are a trifle wider than that, beyond any rounding.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
    split = written(held.join(_checked(large, n_large), "root", "left_semi").withColumn("band", band.cast("long")), "ngram-bands")
    # A set is in as many tiles as there are chunks: chunks grow with the root of the load, up to what a task can hold.
    most = F.greatest(F.sqrt(load()), F.sum("n") / (MOST_CHUNK * chunk_tokens), F.count("*") / (4 * MOST_CHUNK * chunk_docs))
    chunks = written(split.groupBy("root", "band").agg(F.ceil(most).cast("int").alias("k")), "ngram-chunks")
    n_bands = chunks.count()
    beside = lambda d, name: _checked(chunks.select("root", (F.col("band") - d).alias("band"), F.col("k").alias(name)), n_bands)
    split = split.join(beside(0, "k"), ["root", "band"]).join(beside(1, "above"), ["root", "band"], "left").join(beside(-1, "below"), ["root", "band"], "left")
    chunk = F.pmod(F.xxhash64("row"), F.col("k")).cast("int")

    def tile(lower: Column, kind: str, one: Column, other: Column) -> Column:
        return F.concat_ws(":", "root", lower, F.lit(kind), one, other)

    def others(k: Column):
        return F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))

    split = split.withColumn("chunk", chunk)
    c = F.col("chunk")
    own = F.transform(
        others(F.col("k")),
        lambda j: F.struct(tile(F.col("band"), "in", F.least(c, j), F.greatest(c, j)).alias("tile"), F.when(c == j, 0).when(c < j, 1).otherwise(2).alias("side")),
    )
    up = F.transform(others(F.coalesce("above", F.lit(0))), lambda j: F.struct(tile(F.col("band"), "up", c, j).alias("tile"), F.lit(1).alias("side")))
    down = F.transform(others(F.coalesce("below", F.lit(0))), lambda j: F.struct(tile(F.col("band") - 1, "up", j, c).alias("tile"), F.lit(2).alias("side")))
    dealt = split.select("row", "docs", "tokens", F.explode(F.concat(own, up, down)).alias("t"))
    return whole.select(*names).unionByName(dealt.select("t.tile", "row", "t.side", "docs", "tokens"))


def classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, chunk_docs: int = 128, chunk_tokens: int = 1_000_000
) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, text_key, n, row, rep; links: row, links, lead: the documents of linked classes and a class of the component)."""
    docs = only(docs, id_col, text_col)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), text.alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(rows, size))
    sketch = written(rows.mapInArrow(_sketch_task(size, percent, common), SKETCH), "ngram-sketch")
    narrow = sketch.select("row", "doc_id", "text_key", "n", "fp")
    # Null ids sort last, so that a class with any id is represented by one.
    least = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    rep = narrow.filter("n > 0").groupBy("fp").agg(F.min_by(F.struct("row", "doc_id"), least).alias("r"), F.count("*").alias("docs"))
    rep = written(rep.select("fp", F.col("r.row").alias("rep"), "docs"), "ngram-reps")  # joined afresh, so that a hot set's copies can be split over tasks
    members = narrow.join(rep, "fp", "left").select("doc_id", "text_key", "n", "fp", "row", F.coalesce("rep", "row").alias("rep"), F.coalesce("docs", F.lit(1)).alias("docs"))
    members = written(members, "ngram-members")
    copies = members.filter("row <> rep").select("row")
    sets = sketch.filter("n > 0").join(_checked(copies, copies.count()), "row", "left_anti")
    # A shingle of a single class meets nobody and only fills up the prefix.
    room = F.col("prefix") - F.size("first") - F.size("common")
    early = sets.select("row", room.alias("room"), F.explode("first").alias("token"))
    # Counted with map-side sums and written, so that rows of one token can be split over tasks in the join.
    shared = written(early.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "ngram-shared")
    early = early.join(shared, "token")
    late = F.col("token").bitwiseAND(SLICE_OF - 1) >= SLICE
    key = F.struct(late.cast("int").alias("late"), F.when(late, 0).otherwise(F.col("df")).alias("df"), "token")
    ranked = early.select("row", "room", key.alias("k")).groupBy("row", "room").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    taken = F.slice("ks", 1, F.greatest(F.col("room") + F.size("ks"), F.lit(0)))
    meets = ranked.select("row", F.explode(taken).alias("k")).select("row", "k.token").unionByName(sets.select("row", F.explode("common").alias("token")))
    meets = written(meets, "ngram-meets")
    lead = meets.groupBy("token").agg(F.min("row").alias("a"), F.count("*").alias("n")).filter("n > 1").select("token", "a")
    stars = meets.join(lead, "token").filter("a <> row").select("a", F.col("row").alias("b")).distinct()
    known = members.select(F.col("row").alias("node"), "n", "doc_id", "fp", "docs")
    blocks = written(components(stars).join(known, "node"), "ngram-blocks")
    n_blocked = blocks.count()
    if not n_blocked:
        return members, blocks.select(F.col("node").alias("row"), F.col("docs").alias("links"), F.col("root").alias("lead")).limit(0)
    made = _members_texts(rows, blocks, n_blocked).mapInArrow(_set_task(size), "fp binary, tokens binary").dropDuplicates(["fp"])
    held = written(made.join(blocks, "fp").select(F.col("node").alias("row"), "root", "n", "docs", "tokens"), "ngram-sets")
    tiles = _tiles(held, percent, chunk_docs, chunk_tokens)
    loads = blocks.agg(F.sum("n")).first()[0] or 0
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-loads // chunk_tokens))
    tiles = tiles.repartition(tasks, "tile").sortWithinPartitions("tile")
    return members, written(tiles.mapInArrow(_tile_task(percent), "row long, links long, lead long"), "ngram-links")


def text_key(text_col: str) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def _members_texts(rows: DataFrame, blocks: DataFrame, n_blocked: int) -> DataFrame:
    """Texts of the documents that represent a blocked class (by id; other rows of that id drop out by fingerprint)."""
    ids = blocks.select(F.col("doc_id").alias("wanted")).distinct()
    return rows.join(_checked(ids, n_blocked), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")


def _grouped(docs: DataFrame, **options) -> DataFrame:
    members, links = classes(docs, **options)
    # The edges of all tiles; a class in no tile with a link is alone. An empty set is its own class and component.
    roots = components(links.select(F.col("row").alias("a"), F.col("lead").alias("b"))).select(F.col("node").alias("rep"), "root")
    partners = links.groupBy(F.col("row").alias("rep")).agg(F.sum("links").alias("links"))
    placed = members.filter("row = rep").select("rep", "n", "docs").join(roots, "rep", "left").join(partners, "rep", "left")
    n_links = F.when(F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("docs") - 1).otherwise(0)
    # Written, so that the members of a hot class can be split over tasks.
    placed = written(placed.select("rep", F.coalesce("root", "rep").alias("root"), n_links.alias("n_links")), "ngram-placed")
    return members.join(placed, "rep").select("doc_id", "text_key", "n", "root", "n_links")


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row.

    ``component_id`` is the smallest id reachable over links, the document's own included; ``n_links`` the number of other
    rows that the row is linked with. Texts without words (null too) have no shingles and are linked with nothing. Repeated
    rows are linked by their equal sets. Null ids take part; a component of null ids only has a null component_id. An empty
    table gives an empty result; other columns are ignored.
    """
    whole = written(_grouped(docs, **options), "ngram-groups")
    least = written(whole.groupBy("root").agg(F.min("doc_id").alias("component_id")), "ngram-least")
    return whole.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group, one with the smallest id, with all its columns.

    Texts without words are a group each. Of rows that repeat this id and its text, one stays; null ids come after all
    others. An empty table gives an empty result. Other columns stay, whatever their names.
    """
    plain, (id_, text) = positional(docs, id_col, text_col)
    whole = written(_grouped(plain, id_col=id_, text_col=text, **options), "ngram-groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    # Rows without shingles have a root of their own, so each stays.
    stay = written(whole.groupBy("root").agg(first.alias("s")).select("s.doc_id", "s.text_key").distinct(), "ngram-stay")
    twice = written(whole.filter("n > 0").groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key"), "ngram-twice")
    twice = _checked(twice, twice.count())
    own = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    kept = plain.withColumns({"id": F.col(id_).cast("long"), "key": text_key(text)}).join(stay, own, "left_semi")
    # Only repeated rows are numbered.
    one = w.Window.partitionBy("id", "key").orderBy(F.lit(0))
    apart = kept.join(twice, own, "left_semi").withColumn("n", F.row_number().over(one)).filter("n = 1").drop("n")
    return kept.join(twice, own, "left_anti").unionByName(apart).drop("id", "key").toDF(*docs.columns)
