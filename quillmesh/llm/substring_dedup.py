"""Substring deduplication: words covered by a window of ``window`` words that also starts elsewhere are removed.

1. A window's minimiser is the smallest hash of the grams of ``GRAM`` words inside it, so equal windows have equal minimisers.
   Consecutive windows that share one travel as one packed string (a super-k-mer: their words, joined by single spaces) to
   the bucket of that minimiser. A window is in exactly one packed string.
2. A bucket task takes its strings in the order of minimisers, sorts the windows of a minimiser by a hash and compares the
   bytes of those with equal hashes: what repeats is known exactly. Memory is bounded by the strings of one minimiser.
3. A minimiser that alone would burden a bucket is hot: it stems from copies in many texts. Its packed strings are first
   counted under 128-bit digests with map-side sums, which collapses the copies; the windows of the different strings are
   then counted under 128-bit digests of their own, so no key has more rows than tasks.
4. Repeated windows are gathered by the digest of the text that they lie in; equal texts lose the same words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from quillmesh.llm.common import batch_of, positional, written
from quillmesh.llm.ngram_join import STEP, _mix

GRAM = 4
LONGEST_RUN = 128  # windows of a packed string: more have one minimiser only in periodic texts
SEGMENT = 1 << 15  # words that are in memory as arrays at a time
ONE_IN = 8  # texts whose strings are counted to find hot minimisers
MOST_MET = 200_000  # texts or strings that a task remembers
HOT_SHARE = 16  # a minimiser with a 16th of a task's even share of strings is hot
TASK_BYTES, MOST_BYTES, MANY_TASKS = 48 << 20, 2 << 30, 20_000  # packed strings of a task: small while tasks are few
BROADCAST_BYTES = 64 << 20
SECOND_STEP = np.uint64(0xC4CEB9FE1A85EC53)  # of the second half of a digest
LEAST_HOT, MOST_HOT = 64, 1 << 20  # strings of a minimiser from which it can be, and must be, hot
LONG_WORD = 1024  # bytes, beyond which a word is hashed by itself
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(norm: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a text whose words are joined by single spaces."""
    raw = np.frombuffer(norm + bytes(8), dtype=np.uint8)
    gap = np.flatnonzero(raw[: len(norm)] == 32)
    starts, ends = np.concatenate(([0], gap + 1)), np.append(gap, len(norm))
    size = ends - starts
    eight = np.ndarray(len(norm) + 1, dtype="<u8", buffer=raw, strides=(1,))  # the eight bytes from each place on
    out = _mix((eight[starts] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * STEP)
    more, k = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        left = size[more] - k
        out[more] = _mix(out[more] * STEP + (eight[starts[more] + k] & _MASKS[np.minimum(left, 8)]))
        more, k = more[left > 8], k + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(norm[starts[i] : ends[i]])
    return starts, ends, out


def spans_hash(words: np.ndarray, size: int, step: np.uint64 = STEP) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, put together from runs of powers of two."""
    out, done, power, length = None, 0, words, 1
    factor = lambda n: np.uint64(pow(int(step), n, 1 << 64))
    n = len(words) - size + 1
    left = size
    while left:
        if left & 1:
            part = power[done : done + n]
            out = part if out is None else out * factor(length) + part
            done += length
        left >>= 1
        if left:
            power = power[:-length] * factor(length) + power[length:]
            length *= 2
    return _mix(out + np.uint64(size))


def minimisers(words: np.ndarray, window: int) -> np.ndarray:
    """The smallest gram hash inside each window."""
    gram = min(GRAM, window)
    least, width, want = spans_hash(words, gram), 1, window - gram + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least.view(np.int64)


def super_kmers(minis: np.ndarray, part: np.ndarray, longest: int = LONGEST_RUN) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run with one minimiser in one part, cut to ``longest``."""
    first = np.concatenate(([0], np.flatnonzero((minis[1:] != minis[:-1]) | (part[1:] != part[:-1])) + 1))
    size = np.diff(np.append(first, len(minis)))
    pieces = -(-size // longest)
    if (pieces > 1).any():
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + inner * longest
        size = np.diff(np.append(first, len(minis)))
    return first, size


class Piece(NamedTuple):
    """Bytes and words (start, end, hash) of some texts; of each packed string: row of the text, place there, first word here, windows, minimiser."""

    norm: bytes
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    row: np.ndarray
    place: np.ndarray
    first: np.ndarray
    size: np.ndarray
    mini: np.ndarray


@dataclass(frozen=True)
class Cut:
    """How texts are cut: words of a window, words that are in memory as arrays at a time, windows of a packed string at most."""

    window: int
    segment: int = SEGMENT
    longest: int = LONGEST_RUN

    def pieces(self, texts: pa.Array, t1: pa.Array | None = None, t2: pa.Array | None = None, met: Counter | None = None) -> Iterator[Piece]:
        """Short texts together, long ones in several pieces; each window lies in exactly one.

        With digests, a text that a task has met twice is left out from then on: all its windows are known to repeat, and
        what is found of a text holds for its copies.
        """
        held: list[bytes] = []
        parts: list[tuple[int, int, int]] = []
        for row, text in enumerate(texts):
            if met is not None:
                name = (t1[row].as_py(), t2[row].as_py())
                if met[name] > 1:
                    continue
                if len(met) >= MOST_MET:
                    met.clear()
                met[name] += 1
            ws = (text.as_py() or "").encode().split()
            for at in range(0, len(ws) - self.window + 1, self.segment):
                part = ws[at : at + self.segment + self.window - 1]
                held += part
                parts.append((row, at, len(part)))
                if len(held) >= self.segment:
                    yield self._piece(held, parts)
                    held, parts = [], []
        if held:
            yield self._piece(held, parts)

    def _piece(self, held: list[bytes], parts: list[tuple[int, int, int]]) -> Piece:
        norm = b" ".join(held)
        starts, ends, words = word_hashes(norm)
        row, at, count = np.array(parts).T
        windows = count - self.window + 1
        part = np.repeat(np.arange(len(parts)), windows)
        inside = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = (np.cumsum(count) - count)[part] + inside  # windows do not go over from one text to the next
        minis = minimisers(words, self.window)[begin]
        k, size = super_kmers(minis, part, self.longest)
        return Piece(norm, starts, ends, words, row[part[k]], at[part[k]] + inside[k], begin[k], size, minis[k])

    def strings(self, p: Piece, which: np.ndarray) -> list[bytes]:
        last = p.first[which] + p.size[which] + self.window - 2
        return [p.norm[a:b] for a, b in zip(p.starts[p.first[which]].tolist(), p.ends[last].tolist(), strict=True)]


def _schema(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names])


def _count_task(cut: Cut):
    schema = _schema("mini", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in cut.pieces(batch.column(0)):
                yield batch_of(schema, *np.unique(p.mini, return_counts=True))

    return run


PACKED = "t1 long, t2 long, first long, mini long, packed binary"


def _pack_task(cut: Cut, hot: Broadcast):
    """Packed strings of all minimisers that are not hot."""
    schema = _schema("t1", "t2", "first", "mini").append(pa.field("packed", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            for p in cut.pieces(*batch.columns, met):
                mine = np.flatnonzero(~np.isin(p.mini, hot.value))
                row = p.row[mine]
                yield batch_of(schema, t1[row], t2[row], p.place[mine], p.mini[mine], cut.strings(p, mine))

    return run


HOT = "s1 long, s2 long, t1 long, t2 long, first long, d1 array<long>, d2 array<long>"


def _hot_task(cut: Cut, hot: Broadcast):
    """Strings of hot minimisers by their digests: text, place, and of the first in a task the digests of its windows."""
    fields = [pa.field("d1", pa.list_(pa.int64())), pa.field("d2", pa.list_(pa.int64()))]
    schema = pa.schema([*_schema("s1", "s2", "t1", "t2", "first"), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        told: set[int] = set()
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            for p in cut.pieces(*batch.columns, met):
                mine = np.flatnonzero(np.isin(p.mini, hot.value))
                if not len(mine):
                    continue
                digests = [xxhash.xxh3_128_intdigest(x) for x in cut.strings(p, mine)]
                s1, s2 = np.array([divmod(x, 1 << 64) for x in digests], dtype=np.uint64).view(np.int64).T
                halves = spans_hash(p.words, cut.window), spans_hash(_mix(p.words + STEP), cut.window, SECOND_STEP)
                ranges = []
                for x, a, n in zip(digests, p.first[mine].tolist(), p.size[mine].tolist(), strict=True):
                    ranges.append(None if x in told else (a, a + n))
                    told.add(x)
                if len(told) > MOST_MET:
                    told.clear()
                row = p.row[mine]
                yield batch_of(schema, s1, s2, t1[row], t2[row], p.place[mine], *[[r and h.view(np.int64)[r[0] : r[1]] for r in ranges] for h in halves])

    return run


def repeated_windows(packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, n) of each run of windows in the strings that occur more than once among all windows of the strings."""
    whole = b" ".join(packed)
    starts, ends, words = word_hashes(whole)
    lengths = np.array([len(x) + 1 for x in packed])
    head = np.searchsorted(starts, np.cumsum(lengths) - lengths)  # the first word of each string
    windows = np.diff(np.append(head, len(starts))) - window + 1
    owner = np.repeat(np.arange(len(packed)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = head[owner] + offset
    key = spans_hash(words, window)[at]
    order = np.argsort(key, kind="stable")
    same = np.concatenate(([False], key[order][1:] == key[order][:-1], [False]))
    twice = np.zeros(len(key), dtype=bool)
    cut = lambda i: whole[starts[at[i]] : ends[at[i] + window - 1]]
    for a, b in zip(np.flatnonzero(same[1:] & ~same[:-1]).tolist(), np.flatnonzero(same[:-1] & ~same[1:]).tolist(), strict=True):
        group = order[a : b + 1].tolist()
        texts = [cut(i) for i in group]
        if all(t == texts[0] for t in texts):
            twice[group] = True
            continue
        seen: dict[bytes, list[int]] = {}  # different windows of one hash
        for i, t in zip(group, texts, strict=True):
            seen.setdefault(t, []).append(i)
        for members in seen.values():
            twice[members] = len(members) > 1
    before = np.concatenate(([False], twice[:-1])) & (offset > 0)
    begins = np.flatnonzero(twice & ~before)
    after = np.append(twice[1:] & (offset[1:] > 0), False)
    return owner[begins], offset[begins], np.flatnonzero(twice & ~after) - begins + 1


FOUND = "t1 long, t2 long, first long, n long"


def _bucket_task(window: int):
    schema = _schema("t1", "t2", "first", "n")

    def counted(rows: pa.Table) -> pa.RecordBatch:
        string, offset, n = repeated_windows(rows.column("packed").to_pylist(), window)
        t1, t2, first = (rows.column(c).to_numpy()[string] for c in ("t1", "t2", "first"))
        return batch_of(schema, t1, t2, first + offset, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            minis = batch.column("mini").to_numpy()
            edge = int(np.searchsorted(minis, minis[-1]))  # rows come in the order of minimisers; the last one may go on
            if edge or (held and held[-1].column("mini")[-1].as_py() != minis[-1]):
                held.append(batch.slice(0, edge))
                yield counted(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(edge))
        if held:
            yield counted(pa.Table.from_batches(held))

    return run


def _text_digest(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def _tasks(docs: DataFrame, size: int) -> int:
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, min(-(-size // TASK_BYTES), MANY_TASKS), -(-size // MOST_BYTES))


def _hot_windows(texts: DataFrame, cut: Cut, hot: Broadcast) -> DataFrame:
    """t1, t2, first, n of repeated windows whose minimiser is hot."""
    strings = written(texts.mapInArrow(_hot_task(cut, hot), HOT), "substring-strings")
    apart = strings.groupBy("s1", "s2").agg(F.count("*").alias("c"), F.first("d1", True).alias("d1"), F.first("d2", True).alias("d2"))
    single = apart.select("s1", "s2", "c", F.posexplode(F.arrays_zip("d1", "d2")).alias("offset", "d")).select("s1", "s2", "c", "offset", "d.d1", "d.d2")
    single = written(single, "substring-windows")
    # Written, so that windows of very many strings can be split over tasks in the join.
    again = written(single.groupBy("d1", "d2").agg(F.sum("c").alias("c")).filter("c > 1").select("d1", "d2"), "substring-again")
    # Runs of repeated windows inside each different string, then their places in all texts.
    step = F.row_number().over(w.Window.partitionBy("s1", "s2").orderBy("offset"))
    runs = single.drop("c").join(again, ["d1", "d2"]).withColumn("run", F.col("offset") - step)
    runs = written(runs.groupBy("s1", "s2", "run").agg(F.min("offset").alias("offset"), F.count("*").alias("n")), "substring-runs")
    places = strings.select("s1", "s2", "t1", "t2", "first")
    return places.join(runs, ["s1", "s2"]).select("t1", "t2", (F.col("first") + F.col("offset")).alias("first"), "n")


def windows_of_texts(docs: DataFrame, cut: Cut) -> DataFrame:
    """t1, t2 (the digest of a text) and its runs of repeated windows."""
    texts = docs.select("text", *(c.alias(n) for n, c in zip(("t1", "t2"), _text_digest(F.col("text")), strict=True)))
    texts = texts.filter(F.length("text") >= 2 * cut.window - 1)  # others, null too, have no window
    context = docs.sparkSession.sparkContext
    size = 3 * (texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)  # packed strings overlap
    tasks = _tasks(docs, size)
    # Which ones are hot only decides their way, so the strings of one text in ``ONE_IN`` say it. At most 16 HOT_SHARE tasks
    # minimisers can be hot: a packed string of the default window has 70 bytes at least.
    some = texts.filter(F.rand(7) * ONE_IN < 1).select("text")
    counts = some.mapInArrow(_count_task(cut), "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n"))
    bound = max(LEAST_HOT, min(size // (400 * HOT_SHARE * tasks), MOST_HOT))
    found = counts.filter(F.col("n") * ONE_IN > bound).select("mini").toArrow()
    hot = context.broadcast(np.sort(found.column(0).to_numpy().astype(np.int64)))
    packed = texts.mapInArrow(_pack_task(cut, hot), PACKED)
    runs = packed.repartition(tasks, "mini").sortWithinPartitions("mini").mapInArrow(_bucket_task(cut.window), FOUND)
    if len(hot.value):
        runs = runs.unionByName(_hot_windows(texts, cut, hot))
    runs = runs.distinct().groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("runs"))
    return written(runs, "substring-runs-by-text")


KEPT = "n_words long, n_removed long, kept string, spans array<struct<first: long, last: long>>"


def _merged(runs: list[dict], window: int) -> list[tuple[int, int]]:
    """Spans of words [first, last) that the runs of windows cover."""
    out: list[tuple[int, int]] = []
    for r in runs:
        a, b = r["first"], r["first"] + r["n"] + window - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _keep(window: int):
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])

    def run(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts, runs, strict=True):
            words = (text.as_py() or "").encode().split()
            spans = _merged(found.as_py() or [], window)
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out.append({"n_words": len(words), "n_removed": len(words) - len(kept), "kept": b" ".join(kept).decode(), "spans": [{"first": a, "last": b} for a, b in spans]})
        return pa.array(out, kind)

    return F.arrow_udf(run, KEPT)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, **cut: int) -> DataFrame:
    """One row for each document: ``id_col``, n_words, n_removed, kept (the words left, joined by one space), spans (removed words, [first, last)).

    Words are what lies between spaces and control characters 9 to 13, unchanged. A window that occurs twice anywhere, in one
    document too, is removed at both places; windows are judged on the input. Repeated rows lose all words of their windows,
    rows with equal ids are documents of their own. Null and empty texts have no words; texts of fewer than ``window`` words
    stay whole. Texts of any length are read whole, in pieces of ``SEGMENT`` words. An empty table gives an empty result;
    other columns are ignored, whatever their names. ``cut`` are options of ``Cut``.
    """
    plain, (id_, text) = positional(docs, id_col, text_col)
    rows = plain.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    return _applied(rows, Cut(window, **cut)).select(F.col("id").alias(id_col), "x.*")


def remove_repeats(docs: DataFrame, *, text_col: str = "text", window: int = 35, **cut: int) -> DataFrame:
    """The documents with all their columns, the text without the words that ``repeats`` removes; a null text stays null."""
    plain, (text,) = positional(docs, text_col)
    kept = _applied(plain.withColumn("text", F.col(text).cast("string")), Cut(window, **cut))
    changed = F.when(F.col("x.n_removed") > 0, F.col("x.kept")).otherwise(F.col(text))
    return kept.select(*[changed.alias(c) if c == text else c for c in plain.columns]).toDF(*docs.columns)


def _applied(rows: DataFrame, cut: Cut) -> DataFrame:
    """``rows`` (text and others) with what is left of each text as ``x``."""
    found = windows_of_texts(rows, cut)
    n, size = found.agg(F.count("*"), F.sum(F.size("runs"))).first()
    found = F.broadcast(found) if 48 * n + 24 * (size or 0) <= BROADCAST_BYTES else found
    one, two = _text_digest(F.coalesce("text", F.lit("")))
    return rows.withColumns({"t1": one, "t2": two}).join(found, ["t1", "t2"], "left").withColumn("x", _keep(cut.window)(F.col("text"), F.col("runs")))
