"""Exact deduplication and the n-gram join against brute force, on edge cases and on the given tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import exact_dedup, ngram_join
from quillmesh.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, norm string, row string, count int, bucket int, keep_id long"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "y", 2, 3, 4) for i, t in pairs], DOCS)


EDGE = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x " * 30000), (8, "X " * 30000), (9, "Abc"), (9, "Abc"), (None, "abc"), (None, "only null"), (12, " abc")]


def expected(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in pairs:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[low(t)]), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("bits", "capacity", "hot"), [(64, 1024, 1000), (64, 2, 1), (2, 3, 1000), (2, 3, 2)])
def test_groups(spark, bits, capacity, hot):
    """Two-bit keys put all texts in four chains: bytes decide there. Frequent keys collapse before they are dealt."""
    got = exact_dedup.exact_groups(frame(spark, EDGE), hash_bits=bits, capacity=capacity, hot_rows=hot)
    assert sorted(map(tuple, got.collect()), key=str) == expected(EDGE)


def test_directory_doubles_until_nothing_is_overfull(spark):
    _, index = exact_dedup.build_index(frame(spark, [(i, f"text {i}") for i in range(300)]), capacity=20)
    sizes = [r["count"] for r in index.groupBy("bucket").count().collect()]
    assert sum(sizes) == 300 and max(sizes) <= 20 and len(sizes) > 10
    assert index.agg(F.max("depth")).first()[0] >= 4


def test_the_directory_deals_the_keys_to_owners(spark, monkeypatch):
    """Owners have ranges of buckets, a bucket one owner. A directory that names other buckets for a key's slot breaks it up."""
    docs = frame(spark, [(i, f"text {i % 150}") for i in range(300)])
    _, index = exact_dedup.build_index(docs, capacity=10)
    rows = sorted((r["bucket"], r["owner"]) for r in index.select("bucket", "owner").distinct().collect())
    assert len({b for b, _ in rows}) == len(rows) > 10
    assert [o for _, o in rows] == sorted(o for _, o in rows)
    own = exact_dedup.directory

    def doubled(*args):
        slots, fine = own(*args)
        return slots.unionByName(slots.withColumn("bucket", F.col("bucket") + 1)), fine

    monkeypatch.setattr(exact_dedup, "directory", doubled)
    _, broken = exact_dedup.build_index(docs, capacity=10)
    assert broken.count() == 2 * index.count() == 300


@pytest.mark.parametrize("bits", [64, 2])
def test_one_row_stays(spark, bits):
    docs = frame(spark, EDGE)
    got = exact_dedup.exact_dedup(docs, hash_bits=bits)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted([4, 3, 6, 8, 9, None, 12], key=str)


def test_empty_table(spark):
    none = frame(spark, EDGE).limit(0)
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert ngram_join.near_groups(none).count() == 0
    assert ngram_join.keep_one(none).count() == 0


def test_components(spark):
    random.seed(3)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(a != b and x in (a, b) for a, b in links)}


def shingles(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(ws[j : j + 5]) for j in range(max(1, len(ws) - 4))} if ws else set()


def brute(pairs, percent=75):
    """doc_id is unique here; null texts have no shingles."""
    sets = {i: shingles(t) for i, t in pairs}
    root = {i: i for i in sets}
    n_links = dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i in sorted(sets):
        near = {}
        for s in sets[i]:
            for j in where.setdefault(s, []):
                near[j] = near.get(j, 0) + 1
            where[s].append(i)
        for j, k in near.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                n_links[i] += 1
                n_links[j] += 1
    return sorted((i, len(sets[i]), find(i), n_links[i]) for i in sets)


def edited(seed):
    """Families of edited copies on both sides of the threshold, a passage in all, short texts and texts of a few words."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(3))
    passage, pairs = [word() for _ in range(60)], []
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([4, 5, 6, 20, 80, 300]))]
        for _ in range(rnd.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 12)):
                copy[rnd.randrange(len(copy))] = word()
            pairs.append(copy + passage if rnd.random() < 0.3 else copy)
    texts = [rnd.choice([" ", "\n", "\t"]).join(p) for p in pairs] + ["", None, "one", "ONE", " \n ", "a b c d", "A B C D", "x y " * 4000]
    return list(enumerate(texts))


@pytest.mark.parametrize(
    ("seed", "options", "common"),
    [(1, {}, 16), (2, {"chunk_docs": 3, "chunk_tokens": 200}, 2), (5, {"percent": 50, "chunk_docs": 4}, 3), (6, {"percent": 100}, 2)],
)
def test_join_is_exact(spark, monkeypatch, seed, options, common):
    """Also where most shared shingles count as common, and where blocks are cut into many tiles."""
    monkeypatch.setattr(ngram_join, "SAMPLE", 1 if common < 16 else 64)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    pairs = edited(seed)
    got = ngram_join.near_groups(frame(spark, pairs), **options)
    assert sorted(map(tuple, got.collect())) == brute(pairs, options.get("percent", 75))


def test_large_block_of_unlinked_sets(spark):
    """1,200 texts that share few shingles, none alike, around one large family, cut into many tiles."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    shared, base = [[word() for _ in range(12)] for _ in range(6)], [word() for _ in range(90)]
    texts = [" ".join([word() for _ in range(rnd.randrange(8, 40))] + rnd.choice(shared) + [word()]) for _ in range(1200)]
    for _ in range(200):
        copy = list(base)
        copy[rnd.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    pairs = list(enumerate(texts))
    got = ngram_join.near_groups(frame(spark, pairs), chunk_docs=32)
    assert sorted(map(tuple, got.collect())) == brute(pairs)


@pytest.mark.parametrize("sides", [(0,), (1, 2)])
def test_tile_finds_all_links(sides):
    rnd = np.random.default_rng(5)
    bases = [np.sort(rnd.choice(1 << 40, rnd.integers(1, 60), replace=False)) for _ in range(12)]
    sets = []
    for _ in range(300):
        b = bases[rnd.integers(len(bases))]
        sets.append(np.unique(np.concatenate((b[rnd.random(len(b)) < 0.93], rnd.choice(1 << 40, rnd.integers(1, 6)))).astype(np.uint64)))
    side, docs = rnd.choice(sides, len(sets)), rnd.integers(1, 9, len(sets))
    links, lead = ngram_join.join_tile(sets, docs, side, 75)
    want, root = np.zeros(len(sets), dtype=int), list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if (side[i] == 0 or side[i] != side[j]) and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                want[i] += docs[j]
                want[j] += docs[i]
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert (links == want).all()
    assert all((lead[i] == lead[j]) == (root[i] == root[j]) for i in range(len(sets)) for j in range(i))


def test_join_on_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = ngram_join.near_groups(docs)
    assert sorted(map(tuple, got.collect())) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    got = ngram_join.near_groups(frame(spark, [(5, t), (5, t), (None, t), (7, t + " more"), (None, "alone")])).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(5, 5), (5, 5), (None, 5), (7, 5), (None, None)], key=str)


def test_keep_one_keeps_columns(spark):
    t = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(5, t), (7, t + " more"), (8, None), (9, "")])
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [5, 8, 9]


def test_keep_one_of_repeated_rows(spark):
    """Two groups that share an id: a row of each stays, whatever repeats."""
    t, u = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    docs = frame(spark, [(5, t), (5, t), (3, t + " more"), (5, u), (6, u + " more"), (5, u), (4, None), (4, None), (None, u)])
    got = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, t + " more"), (5, u), (4, None), (4, None)], key=str)
