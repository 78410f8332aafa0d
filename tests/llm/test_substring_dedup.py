"""Substring deduplication against brute force: both ways for minimisers, edge cases, clashing names."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillmesh.llm import substring_dedup

NAMES = "t1 long, t2 long, first int, mini string, packed string, runs int, x string, row string, id int, T1 int, kept int, n_words int, n_removed int, spans int"
KIND = f"doc_id long, text string, {NAMES}"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, *[None] * (NAMES.count(",") + 1)) for i, t in pairs], KIND)


def brute(pairs, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in pairs]
    count = Counter(tuple(ws[j : j + window]) for ws in split for j in range(len(ws) - window + 1))
    out = []
    for (i, _), ws in zip(pairs, split, strict=True):
        gone = {p for j in range(len(ws) - window + 1) if count[tuple(ws[j : j + window])] > 1 for p in range(j, j + window)}
        out.append((i, len(ws), len(gone), " ".join(x for p, x in enumerate(ws) if p not in gone)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(60))
    rows = [(i, " ".join(f"x{rng.randrange(4000)}" for _ in range(rng.randrange(5, 90)))) for i in range(40)]
    rows += [(100 + i, f"{rows[i][1]} {passage} {rows[-i][1]}") for i in range(25)]  # one passage in many contexts
    rows += [(200 + i, rows[0][1] + "\n\t" + passage) for i in range(5)]  # copies
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "one"), (304, "ab " * 3000), (305, "a b c " * 700), (None, passage), (None, None), (300, passage)]
    rows += [(306, passage.replace(" ", " ")), (307, passage.replace(" ", "\x0b \n")), (308, "Ab " + passage.upper()), (309, "y" * 100_000 + " " + passage), (310, "\x00 " * 40)]
    rows += [(311, " ".join(f"z{k}" for k in range(40_000)) + " " + passage)]
    return rows


@pytest.mark.parametrize("window", [35, 3])
@pytest.mark.parametrize("hot", [False, True])
def test_against_brute_force(spark, monkeypatch, hot, window):
    """``hot`` makes minimisers of three strings hot, and pieces of a text and packed strings short."""
    options = {}
    if hot:
        monkeypatch.setattr(substring_dedup, "LEAST_HOT", 2)
        monkeypatch.setattr(substring_dedup, "ONE_IN", 1)
        options = {"segment": 50, "longest": 4}
    got = substring_dedup.repeats(frame(spark, corpus()).repartition(4), window=window, **options)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()), key=str) == brute(corpus(), window)


def test_the_bound_of_hot_minimisers_is_met(spark, monkeypatch):
    seen = []
    own = substring_dedup._hot_windows
    monkeypatch.setattr(substring_dedup, "_hot_windows", lambda *args: seen.append(len(args[2].value)) or own(*args))
    rows = [(i, f"start{i} " + " ".join(f"w{k}" for k in range(80))) for i in range(120)]
    got = substring_dedup.repeats(frame(spark, rows)).collect()
    assert seen and seen[0] > 0
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == brute(rows, 35)


def test_all_columns_stay(spark):
    rows = corpus()
    docs = frame(spark, rows)
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == docs.columns
    want = {(i, t): kept if n else t for (i, _, n, kept), (_, t) in zip(sorted_like(rows), rows, strict=True)}
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(((i, want[i, t]) for i, t in rows), key=str)


def sorted_like(rows):
    """``brute`` in the order of the rows."""
    numbered = brute([((k, i), t) for k, (i, t) in enumerate(rows)], 35)
    return [(key[1], n, m, kept) for key, n, m, kept in sorted(numbered, key=lambda r: r[0][0])]


def test_no_rows(spark):
    none = frame(spark, []).limit(0)
    assert substring_dedup.repeats(none).count() == 0
    assert substring_dedup.remove_repeats(none).columns == none.columns


def test_a_packed_string_holds_each_window_once():
    words = np.arange(500, dtype=np.uint64) * np.uint64(7919)
    minis = substring_dedup.minimisers(words, 35)
    grams = substring_dedup.spans_hash(words, 4)
    assert [int(x) for x in minis.view(np.uint64)] == [int(grams[i : i + 32].min()) for i in range(466)]
    first, size = substring_dedup.super_kmers(minis, np.zeros(466, dtype=int))
    assert size.sum() == 466 and (first[1:] == first[:-1] + size[:-1]).all()
