"""Benchmark decontamination: a generalised suffix automaton of the normalised items, over which training words stream.

The longest match that ends at each word says whether a window of an item ends there. Items are dealt to blocks of bounded
size. Tasks build one automaton for each block and write them to the shared folder; each block is then one pass over the
documents, with that one automaton broadcast, so the item set may grow and a task's memory does not.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import only, positional, written

BROADCAST_ROWS = 100_000
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of digits, letters a-z (after lower-casing A-Z) and everything beyond ASCII, in UTF-8."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class Automaton:
    """Suffix automaton of all items of a block; a string of words leads to a state if and only if it lies in some item."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for item, ws in items if ws]
        for _, ids in coded:
            last = 0
            for t in ids:
                last = self._extend(last, t)
        n = len(self.next)
        self.windows: dict[int, set] = {}  # state of a window: the items it lies in
        self.short: dict[int, list] = {}  # state of a whole item shorter than a window: (length, item)
        for item, ids in coded:
            need, s = min(window, len(ids)), 0
            for i, t in enumerate(ids):
                s = self.next[s][t]
                while self.length[self.link[s]] >= need:
                    s = self.link[s]
                if i + 1 >= need:
                    if len(ids) >= window:
                        self.windows.setdefault(s, set()).add(item)
                    else:
                        self.short.setdefault(s, []).append((need, item))
        self.has_short = [False] * n
        if self.short:
            for s in sorted(range(1, n), key=self.length.__getitem__):
                self.has_short[s] = s in self.short or self.has_short[self.link[s]]

    def _extend(self, last: int, t: int) -> int:
        have = self.next[last].get(t)
        if have is not None and self.length[have] == self.length[last] + 1:
            return have
        if have is not None:
            return self._split(last, t, have)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
        return new

    def _split(self, p: int, t: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = copy
            p = self.link[p]
        return copy

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [start, end) spans of the words inside occurring windows, and the items whose windows occur."""
        follow, link, length, window, has_short = self.next, self.link, self.length, self.window, self.has_short
        spans: list[list[int]] = []
        items: set = set()

        def mark(i: int, n: int) -> None:
            start = i + 1 - n
            while spans and spans[-1][0] >= start:
                spans.pop()
            if spans and spans[-1][1] >= start:
                spans[-1][1] = i + 1
            else:
                spans.append([start, i + 1])

        met: set[int] = set()  # states of windows; a passage that many items share is looked up once
        s = n = 0
        for i, t in enumerate(map(self.vocab.get, ws)):
            if t is None:
                s = n = 0
                continue
            to = follow[s].get(t)
            if to is None:
                while to is None:
                    s = link[s]
                    to = follow[s].get(t)
                n = length[s]
            s, n = to, n + 1
            if n >= window:
                p = s
                while length[link[p]] >= window:
                    p = link[p]
                met.add(p)
                mark(i, window)
            if has_short[s]:
                p = s
                while has_short[p]:
                    for size, item in self.short.get(p, ()):
                        if size <= n:
                            items.add(item)
                            mark(i, size)
                    p = link[p]
        for p in met:
            items |= self.windows.get(p, set())
        return [(a, b) for a, b in spans], items


NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def build(items: DataFrame, *, id_col: str, text_col: str, window: int, block_words: int) -> tuple[DataFrame, int]:
    """(block, automaton) with one pickled automaton of about ``block_words`` words in each row, and the number of blocks."""
    items = only(items, id_col, text_col)
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text IS NOT NULL")
    n = rows.agg(F.sum(F.size(F.split("text", NOT_WORD)))).first()[0] or 0
    blocks = max(1, -(-n // block_words))

    def automaton(pdf: pd.DataFrame) -> pd.DataFrame:
        made = Automaton([(i, words(t)) for i, t in zip(pdf["item"], pdf["text"], strict=True)], window)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "automaton": [pickle.dumps(made, pickle.HIGHEST_PROTOCOL)]})

    block = F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")
    made = rows.withColumn("block", block).groupBy("block").applyInPandas(automaton, "block int, automaton binary")
    return written(made, "decontamination-automata"), blocks


def _load(automata: DataFrame, block: int, window: int) -> Broadcast:
    """One block's automaton, pickled, for the tasks of one pass; an empty one if no item is in the block."""
    row = automata.filter(F.col("block") == block).select("automaton").first()
    payload = bytes(row[0]) if row else pickle.dumps(Automaton([], window))
    return automata.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, payload))


_LOADED: dict[str, Automaton] = {}


def _loaded(shared: Broadcast) -> Automaton:
    """The automaton of this pass; a worker keeps one at a time."""
    name, payload = shared.value
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = pickle.loads(payload)
    return _LOADED[name]


FOUND = "n_words long, spans array<struct<start: int, stop: int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _scan_task(shared: Broadcast, all_rows: bool):
    """Adds n_words, spans and items to all columns but the last, the text; without ``all_rows`` only for rows that are hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _loaded(shared)
        for batch in batches:
            count, spans, items = [], [], []
            for text in batch.columns[-1]:
                ws = words(text.as_py())
                found, hit = automaton.scan(ws)
                count.append(len(ws))
                spans.append([{"start": a, "stop": b} for a, b in found])
                items.append(sorted(x for x in hit if x is not None))
            arrays = [*batch.columns[:-1], pa.array(count, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "n_words", "spans", "items"])
            yield out if all_rows else out.filter(pa.array([bool(x) for x in spans], pa.bool_()))

    return run


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        merged = []
        for spans in batch.column(2).to_pylist():
            out: list[dict[str, int]] = []
            for x in sorted(spans, key=lambda s: s["start"]):
                if out and out[-1]["stop"] >= x["start"]:
                    out[-1]["stop"] = max(out[-1]["stop"], x["stop"])
                else:
                    out.append(x)
            merged.append(out)
        arrays = [batch.column(0), batch.column(1), pa.array(merged, _SPANS), batch.column(3)]
        yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds a 128-bit key of the text: equal texts are hit alike."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.withColumns({"__key1": F.xxhash64(text), "__key2": F.xxhash64(F.lit(1), text)})


def _hits(keyed: DataFrame, text_col: str, automata: DataFrame, blocks: int, window: int) -> DataFrame:
    """__key1, __key2, spans (merged), items of texts hit in any block. Each block is a pass of its own."""
    rows = keyed.select("__key1", "__key2", F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = None
    for block in range(blocks):
        shared = _load(automata, block, window)
        found = written(rows.mapInArrow(_scan_task(shared, False), "__key1 long, __key2 long, " + FOUND), "decontamination-hits")
        shared.destroy()
        parts = found if parts is None else parts.unionByName(found)
    # Repeated texts give equal rows; spans of different blocks may overlap or touch.
    once = parts.dropDuplicates(["__key1", "__key2", "spans", "items"]).groupBy("__key1", "__key2")
    once = once.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return written(once.mapInArrow(_merge_task, "__key1 long, __key2 long, spans array<struct<start: int, stop: int>>, items array<string>"), "decontamination-merged")


def _with_hits(keyed: DataFrame, hits: DataFrame, n_hits: int) -> DataFrame:
    hits = F.broadcast(hits) if n_hits <= BROADCAST_ROWS else hits
    return keyed.join(hits, ["__key1", "__key2"], "left").drop("__key1", "__key2")


def matches(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, block_words: int = 200_000,
) -> DataFrame:
    """One row for each document: doc_id, n_words, spans (word positions hit), items (ids, as strings, of items with occurring windows).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null texts
    have no words. Repeated rows and null ids stay; empty tables give no rows or no hits; other columns are ignored. Items
    of a null id are searched for too, and not listed.
    """
    automata, blocks = build(items, id_col=item_id, text_col=item_text, window=window, block_words=block_words)
    docs = only(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if blocks == 1:
        return rows.mapInArrow(_scan_task(_load(automata, 0, window), True), "doc_id long, " + FOUND)
    keyed = _keyed(rows, "text")
    hits = _hits(keyed, "text", automata, blocks, window)
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), NOT_WORD), lambda x: x != "")).cast("long")
    found = _with_hits(keyed.withColumn("n_words", n_words).drop("text"), hits, hits.count())
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    return found.select("doc_id", "n_words", none("spans", "array<struct<start: int, stop: int>>"), none("items", "array<string>"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and item digest of ``matches``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    listed = F.array_join(F.array_sort("items"), ",")
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut(text: str, ws: list[bytes], spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    raw = text.encode()
    flat, at, ends = raw.translate(_WORD_BYTES), 0, []
    for w in ws:
        at = flat.index(w, at)
        ends.append((at, at := at + len(w)))
    keep, done = [], 0
    for a, b in spans:
        keep.append(raw[done : ends[a][0]])
        done = ends[b - 1][1]
    keep.append(raw[done:])
    return b"".join(keep).decode()


def _clean(text: str, spans: list[tuple[int, int]], max_coverage: float) -> str | None:
    """The text without the spans; None if they cover more than ``max_coverage`` of its words, or all."""
    ws = words(text)
    hit = sum(b - a for a, b in spans)
    return None if hit > max_coverage * len(ws) or hit == len(ws) else cut(text, ws, spans)


def _replaced(batch: pa.RecordBatch, text_col: str, length_col: str | None, new: list[str | None]) -> pa.RecordBatch:
    """The batch with new texts, and lengths where texts changed; rows whose text was given up (null only now) go."""
    at = batch.schema.get_field_index(text_col)
    old = batch.column(at).to_pylist()
    columns = list(batch.columns)
    columns[at] = pa.array(new, batch.schema.field(at).type)
    if length_col is not None:
        k = batch.schema.get_field_index(length_col)
        lengths = [n if a == b or b is None else len(b) for n, a, b in zip(columns[k].to_pylist(), old, new, strict=True)]
        columns[k] = pa.array(lengths, batch.schema.field(k).type)
    stay = pa.array([b is not None or a is None for a, b in zip(old, new, strict=True)], pa.bool_())
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(stay)


def decontaminate(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", length_col: str | None = None, item_id: str = "item_id", item_text: str = "text", window: int = 10,
    max_coverage: float = 0.5, block_words: int = 200_000,
) -> DataFrame:
    """The documents without benchmark spans; those with more than ``max_coverage`` of their words in spans, or all, go.

    Cutting goes on until nothing is hit; the limit holds for the first cut, and a text never ends without words that way.
    Clean rows stay as they are, null and empty texts too; repeated rows are treated alike; empty tables give no rows or
    change nothing. Other columns stay, whatever their names. ``length_col`` names a column with the text's length in code points, which follows where a text was cut.
    """
    plain, (text, *length) = positional(docs, text_col, *([length_col] if length_col else []))
    return _decontaminated(plain, items, text, *(length or [None]), item_id, item_text, window, max_coverage, block_words).toDF(*docs.columns)


def _decontaminated(docs: DataFrame, items: DataFrame, text_col: str, length_col: str | None, item_id: str, item_text: str, window: int, max_coverage: float, block_words: int) -> DataFrame:
    automata, blocks = build(items, id_col=item_id, text_col=item_text, window=window, block_words=block_words)
    if blocks == 1:
        shared = _load(automata, 0, window)

        def until_clean(text: str | None) -> str | None:
            limit = max_coverage
            while text is not None and (spans := _loaded(shared).scan(words(text))[0]):
                text, limit = _clean(text, spans, limit), 1.0
            return text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield _replaced(batch, text_col, length_col, [until_clean(t) for t in texts])

        return docs.mapInArrow(run, docs.schema)

    def one_cut(limit: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *columns, spans = batch.columns
                own = pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))
                texts = own.column(own.schema.get_field_index(text_col)).to_pylist()
                found = [[(x["start"], x["stop"]) for x in s or ()] for s in spans.to_pylist()]
                yield _replaced(own, text_col, length_col, [_clean(t, s, limit) if s else t for t, s in zip(texts, found, strict=True)])

        return run

    left, limit = docs, max_coverage
    while True:  # a cut may join the words of a window, so what was cut is searched again
        keyed = _keyed(left, text_col)
        hits = _hits(keyed, text_col, automata, blocks, window)
        n_hits = hits.count()
        if not n_hits:
            return left
        found = _with_hits(keyed, hits.select("__key1", "__key2", F.col("spans").alias("__spans")), n_hits)
        left, limit = written(found.mapInArrow(one_cut(limit), docs.schema), "decontamination-cut"), 1.0
