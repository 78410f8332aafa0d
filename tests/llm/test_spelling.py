"""Spelling variants against brute force: all pairs of words, with frequent grams, long lists, edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from quillmesh.llm import spelling


def near(a, b):
    """One inserted, deleted or replaced character apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    head = next((k for k, x in enumerate(a) if x != b[k]), len(a))
    return len(b) == len(a) + 1 and b[:head] + b[head + 1 :] == a


def brute(words, times=5):
    neighbours = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        top = min(neighbours[w], key=lambda x: (-words[x], x), default=None)
        if top is not None and words[top] >= times * n:
            form[w] = top

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(neighbours[w]), words[form[w]] if w in form else None) for w, n in words.items())


def vocabulary(seed):
    rng = random.Random(seed)
    words = {}
    for _ in range(120):
        w = "".join(rng.choice("abcé") for _ in range(rng.randrange(6, 12)))
        for _ in range(3):
            words[w] = rng.choice([5, 6, 30, 31, 200, 1000, 1000])
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÿ") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1 :]])
            if len(w) < 6:
                break
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaab": 25, "ababab": 9, "bababa": 9, "bababab": 9, "a" * 5000: 7, "a" * 2500 + "b" + "a" * 2499: 50, "a" * 5001: 35, "×÷×÷×÷": 5, "÷×÷×÷×": 5}
    return words


@pytest.mark.parametrize(("least", "long_list"), [(32, 4096), (2, 4096), (2, 3), (10**6, 50)])
def test_near_words(spark, monkeypatch, least, long_list):
    """Few frequent grams, many, none; lists in tiles of three words."""
    monkeypatch.setattr(spelling, "LEAST_FREQUENT", least)
    monkeypatch.setattr(spelling, "LONG_LIST", long_list)
    words = vocabulary(least)
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute(words)


def test_some_gram_survives_any_edit():
    """The bound is met by every edit of every word, and is 1 at least; survivors keep their distance from an end."""
    rng = random.Random(1)
    words = sorted(w for w in vocabulary(3) if len(w) < 50)
    grams = Counter((spelling.START + w + spelling.END)[p : p + q] for w in words for q in range(2, 8) for p in range(len(w) + 3 - q))
    frequent = {g: n for g, n in grams.items() if n > 8}
    tails = spelling.tails_of(frequent)
    for w in rng.sample(words, 150):
        edits = [w[:k] + x + w[k + more :] for k in range(len(w) + 1) for more in (0, 1) for x in ("", "a", "z", "é") if (x or more) and k + more <= len(w)]
        for v in edits:
            c = min(len(w), len(v))
            longest = spelling.longest_gram(c)
            kept = []
            for s in (spelling.START + w + spelling.END, spelling.START + v + spelling.END):
                at = spelling.decompose(s, frequent, longest)
                least = spelling.bound(s, at, frequent, tails, longest)
                assert least >= 1 or c < 6
                kept.append(({(s[p:e], p) for p, e in at} | {(s[p:e], e - len(s)) for p, e in at}, least))
            shared = {g for g, _ in kept[0][0] & kept[1][0]}
            assert len(shared) >= max(kept[0][1], kept[1][1]) or v == w


def test_counting(spark):
    def low(x):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)

    rows = [(1, "Banana banana BANANA, bananas_x ÉCOLES écoles"), (2, None), (3, ""), (None, "banana Étable"), (1, "banana"), (4, "x" * 100_000 + " " + "Banana1banana " * 50), (5, "école×école naïveté"), (6, "short words only")]
    docs = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], "doc_id long, text string, word string, n int, WORD string")
    for spoil in (0, 3):
        want = Counter()
        for i, t in rows:
            for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                w = low(w)
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if spoil and h % spoil == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                want[w] += 1
        got = spelling.count_words(docs, spoil=spoil, least=1)
        assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 6}
    assert spelling.spelling_variants(docs, least=2).count() == 1


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(none).count() == 0
