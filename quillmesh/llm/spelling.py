"""Spelling variants: words within one edit of each other, found over an index of variable-length grams.

1. Words are counted over all texts, summed inside tasks first.
2. Gram dictionary. Grams of ``SHORTEST`` characters or more are counted over the words; a gram that is frequent is replaced by its
   extensions, one that is not stays and is never extended. Frequent grams are few by their bound, so they ride in a broadcast.
3. A word is decomposed into the shortest grams that are not frequent, at each place, without those that lie inside the one
   before. One edit changes only grams around it; the word's bound is the number of different grams that survive the worst edit.
4. Lists. Words that are one edit apart share as many grams as either bound says, each at the same distance from the start
   or from the end. So it is enough to list a word under the first few grams of an order that is the same for all.
5. Merging. A task merges lists: pairs of a list are compared by the bitmaps of their grams against the bounds, and the rest is
   verified by characters. Long lists are cut into tiles, each pair of a list is in one.

Words of ``c`` and ``c + 1`` characters form a class with grams of at most (c + 2) / 2 characters: so some gram survives any edit.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import batch_of, positional, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
PIECE = 1 << 22  # characters of a text whose runs are in memory at a time
FLUSH = 500_000  # different words that a task holds
SHORTEST, LONGEST = 2, 8  # characters of a gram
LEAST_FREQUENT, MOST_GRAMS = 32, 1 << 16  # a gram in over 32 places, and in over a 2**16th of all, is frequent
START, END = "\x01", "\x02"
LONG_LIST = 4096  # words of a list, beyond which it is cut into tiles
PAIR_CELLS = 1 << 24  # characters compared at a time


def low(run: str) -> str:
    """Lower-cases A-Z only."""
    return run.lower() if run.isascii() else "".join(c.lower() if c < "\x80" else c for c in run)


def _runs(text: str) -> Counter:
    if len(text) <= PIECE:
        return Counter(RUN.findall(text))
    found: Counter = Counter()
    for m in RUN.finditer(text):
        found[m[0]] += 1
    return found


def _count_task(spoil: int, shortest: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                begun = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in _runs(text.as_py() or "").items():
                    word = low(word)
                    h = zlib.crc32(word.encode(), begun)
                    if spoil and h % spoil == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                    if len(word) >= shortest:
                        held[word] = held.get(word, 0) + n
                if len(held) > FLUSH:
                    yield batch_of(schema, list(held), list(held.values()))
                    held = {}
        yield batch_of(schema, list(held), list(held.values()))

    return run


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", spoil: int = 0, shortest: int = 6, least: int = 5) -> DataFrame:
    """word, n: runs of letters with A-Z lower-cased, of ``shortest`` characters and ``least`` occurrences or more.

    ``spoil`` > 0 plants misspellings: where it divides the crc32 of ``id:word``, the word loses the character at that number
    modulo its length, and counts as what is left. A null id is written as nothing, a null text has no words.
    """
    plain, (id_, text) = positional(docs, id_col, text_col)
    rows = plain.select(F.col(id_).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    counts = rows.mapInArrow(_count_task(spoil, shortest), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def longest_gram(c: int) -> int:
    return max(SHORTEST, min(LONGEST, (c + 2) // 2))


def _gram_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])
    held: Counter = Counter()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            s = START + word + END
            for q in range(SHORTEST, LONGEST):
                held.update(s[p : p + q] for p in range(len(s) - q + 1))
            if len(held) > FLUSH:
                yield batch_of(schema, list(held), list(held.values()))
                held.clear()
    yield batch_of(schema, list(held), list(held.values()))


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """Grams that are extended, with their numbers of places. Of each length there are at most ``MOST_GRAMS``."""
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    counts = words.select("word").mapInArrow(_gram_task, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") > max(LEAST_FREQUENT, -(-places // MOST_GRAMS))).toArrow()
    return dict(zip(found.column("gram").to_pylist(), found.column("n").to_pylist(), strict=True))


def tails_of(frequent: dict[str, int]) -> set[str]:
    return {g[k:] for g in frequent for k in range(1, len(g))}


def decompose(s: str, frequent: dict[str, int], longest: int) -> list[tuple[int, int]]:
    """(start, end) of the grams of a padded word: at each place the shortest that is not frequent, unless it lies in the one before."""
    out, reach = [], 0
    for p in range(len(s) - 1):
        e = p + SHORTEST
        while e - p < longest and e < len(s) and s[p:e] in frequent:
            e += 1
        if e > reach:
            out.append((p, e))
            reach = e
    return out


def bound(s: str, grams: list[tuple[int, int]], frequent: dict[str, int], tails: set[str], longest: int) -> int:
    """The least number of different grams that one edit leaves, at any place inside the padding.

    The edit keeps s[:i] and s[j:]. It touches grams over its place; grams to the left from the first place whose frequent gram
    ends at the edit and so may now go on; and grams to the right that may now lie in a gram that begins at the edit or before.
    """
    n, names = len(s), [s[p:e] for p, e in grams]
    places, starts, ends = Counter(names), [p for p, _ in grams], [e for _, e in grams]
    most = 0
    for i in range(1, n):
        first = next((p for p in range(max(0, i - longest + 1), i - 1) if s[p:i] in frequent), i)
        left = min(bisect_left(starts, first), bisect_right(ends, i))  # grams before it survive
        for j in (i, i + 1):
            if j == n:
                continue
            last = min(n, j + longest - 1)
            while last > j + 1 and s[j : last - 1] not in tails:
                last -= 1
            right = max(bisect_left(starts, j), bisect_right(ends, last))  # so do grams from here on
            touched = Counter(names[left:right])
            most = max(most, sum(places[g] == k for g, k in touched.items()))
    return len(places) - most


LISTS = "cls int, key long, word string, bits long, need int"


def _list_task(frequent: Broadcast):
    schema = pa.schema([("cls", pa.int32()), ("key", pa.int64()), ("word", pa.string()), ("bits", pa.int64()), ("need", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        tails = tails_of(often)
        rank = lambda g: (often.get(g, 0), -len(g), g)  # noqa: E731  rare and long ones first
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                s = START + word + END
                for c in (len(word) - 1, len(word)):
                    longest = longest_gram(c)
                    at = decompose(s, often, longest)
                    grams = sorted({s[p:e] for p, e in at}, key=rank)
                    least = bound(s, at, often, tails, longest)
                    bits = 0
                    for g in grams:
                        bits |= 1 << (xxhash.xxh32_intdigest(g) & 63)
                    lost = len(grams) - least
                    early = set(grams[: lost + 1])
                    keys = {f"{c}{side}{k}{s[p:e]}" for p, e in at if s[p:e] in early for side, k in (("<", p), (">", len(s) - e))}
                    signed = bits - (1 << 64) if bits >> 63 else bits
                    rows += [(c, xxhash.xxh64_intdigest(k) - (1 << 63), word, signed, bits.bit_count() - lost) for k in keys]
            if rows:
                yield batch_of(schema, *zip(*rows, strict=True))

    return run


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of ``short`` (m x c characters) that are one inserted character away from those of ``long`` (m x c + 1)."""
    c = short.shape[1]
    head = np.logical_and.accumulate(short == long[:, :c], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= c


def merge(lists: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of near words among rows of one class, sorted by list: key, low, high, chunk, word, bits, need."""
    c = int(lists["cls"].iloc[0])
    size = lists["word"].str.len().to_numpy()
    code = np.zeros((len(lists), c + 1), dtype=np.uint8)
    whole = np.frombuffer("".join(lists["word"]).encode("latin-1"), dtype=np.uint8)
    code[np.arange(c + 1) < size[:, None]] = whole
    bits, need, chunk = lists["bits"].to_numpy().view(np.uint64), lists["need"].to_numpy(), lists["chunk"].to_numpy()
    key = lists[["key", "low", "high"]].to_numpy()
    edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
    ends = np.repeat(np.append(edge, len(lists)), np.diff(np.concatenate(([0], edge, [len(lists)]))))
    partners = ends - np.arange(len(lists)) - 1
    total = np.cumsum(partners)
    most = max(1, PAIR_CELLS // (c + 1))
    left, right, at = [], [], 0
    while at < len(lists):
        upto = max(at + 1, int(np.searchsorted(total, total[at] - partners[at] + most, side="right")))
        n = partners[at:upto]
        i = np.repeat(np.arange(at, upto), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = upto
        apart = (chunk[i] != chunk[j]) == (key[i, 1] != key[i, 2])  # a tile of two chunks joins one with the other
        fits = apart & (size[i] + size[j] <= 2 * c + 1) & (np.bitwise_count(bits[i] & bits[j]) >= np.maximum(need[i], need[j]))
        i, j = i[fits], j[fits]
        even = size[i] == size[j]
        near = np.zeros(len(i), dtype=bool)
        near[even] = (code[i[even], :c] != code[j[even], :c]).sum(axis=1) == 1
        short, long = np.where(size[i] <= size[j], i, j)[~even], np.where(size[i] <= size[j], j, i)[~even]
        near[~even] = one_edit(code[short, :c], code[long])
        left.append(i[near])
        right.append(j[near])
    return np.concatenate(left), np.concatenate(right)


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near words; rows come sorted by class and list, and whole lists are merged together."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])

    def pairs(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        for _, lists in rows.groupby("cls"):
            i, j = merge(lists)
            word = lists["word"].to_numpy()
            found = {(a, b) if a < b else (b, a) for a, b in zip(word[i].tolist(), word[j].tolist(), strict=True)}
            yield batch_of(schema, *(zip(*found, strict=True) if found else ([], [])))

    held: list[pd.DataFrame] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.to_pandas()
        names = rows[["cls", "key", "low", "high"]].to_numpy()
        edge = int(np.argmax((names == names[-1]).all(axis=1)))  # the last list may go on
        if edge or (held and (held[-1][["cls", "key", "low", "high"]].iloc[-1].to_numpy() != names[-1]).any()):
            held.append(rows.iloc[:edge])
            yield from pairs(pd.concat(held))
            held = []
        held.append(rows.iloc[edge:])
    if held:
        yield from pairs(pd.concat(held))


def near_words(words: DataFrame) -> DataFrame:
    """a, b: each pair of ``words`` (word of Latin-1 characters) that are one inserted, deleted or replaced character apart; a < b."""
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words))
    lists = written(words.select("word").mapInArrow(_list_task(frequent), LISTS), "variants-lists")
    # Lists of one word meet nobody; long ones are cut into chunks, and a tile joins one with itself or with another.
    sizes = lists.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / LONG_LIST).cast("int").alias("k"))
    dealt = lists.join(sizes, "key").withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tiles = dealt.select("cls", "key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "word", "bits", "need")
    tiles = tiles.repartition("cls", "key", "low", "high").sortWithinPartitions("cls", "key", "low", "high")
    return tiles.mapInArrow(_merge_task, "a string, b string").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms. A form is several times as frequent, so chains are short and end."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "variants-roots")
    while not at.filter("moved").isEmpty():
        up = at.select(F.col("word").alias("root"), F.col("root").alias("top"))
        at = at.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        at = written(at, "variants-roots")
    return at.select("word", "root")


def variants(words: DataFrame, *, times: int = 5) -> DataFrame:
    """(word, n) -> word, form, root, n, n_near, form_n for each word.

    ``form`` is the near word of the largest n (the first in code-point order on ties) if that is at least ``times`` the
    word's own, else null; ``root`` follows the forms to the last, and is the word itself where there is none. Words are
    different and not null; they may have any length. An empty table gives an empty result.
    """
    words = written(words.select("word", "n"), "variants-words")
    pairs = near_words(words)
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = links.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = known.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "b")).alias("best"))
    out = words.join(best, "word", "left").withColumn("taken", -F.col("best.n") >= times * F.col("n"))
    out = out.select(
        "word", F.when(F.col("taken"), F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("taken"), -F.col("best.n")).alias("form_n"),
    )
    out = written(out, "variants-forms")
    roots = _roots(out.filter("form IS NOT NULL").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", spoil: int = 0, shortest: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """``variants`` of the words that ``count_words`` finds in the documents.

    Null, empty and repeated rows count as they are; texts of any length are read whole; other columns are ignored.
    """
    return variants(count_words(docs, id_col=id_col, text_col=text_col, spoil=spoil, shortest=shortest, least=least), times=times)
