"""Models on held-out rows and against brute force; the pipeline's decisions."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from quillmesh.llm import decontaminate, lm_score, packing, queries, toxicity
from test_dedup_and_join import brute, low

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_recursion_sums_all_segmentations():
    pieces = {"▁": math.log(0.1), "▁a": math.log(0.2), "a": math.log(0.05), "ab": math.log(0.1), "b": math.log(0.07), "▁ab": math.log(0.02)}
    lattice = lm_score.Lattice(pieces, [math.log(1e-4)] * 256)

    def all_ways(s):
        if not s:
            return 1.0
        return sum(math.exp(pieces[s[:k]]) * all_ways(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces)

    for n in range(5):
        for w in itertools.product("ab", repeat=n):
            s = "▁" + "".join(w)
            assert math.isclose(math.exp(lattice.log_prob(s)), all_ways(s))
    assert math.isclose(lattice.log_prob("▁é"), math.log(0.1) + 2 * math.log(1e-4))
    uses = [0.0] * len(lattice.logp)
    lattice.expect("▁ab", 1.0, uses)
    ways = [(0.02, ["▁ab"]), (0.2 * 0.07, ["▁a", "b"]), (0.1 * 0.1, ["▁", "ab"]), (0.1 * 0.05 * 0.07, ["▁", "a", "b"])]
    total = sum(p for p, _ in ways)
    for k, name in enumerate(lattice.names):
        assert math.isclose(uses[k], sum(p for p, x in ways if name in x) / total, abs_tol=1e-12)


@pytest.mark.parametrize("n", [1, 5, 63, 64, 65, 200, 5000])
def test_expected_uses_of_words_of_any_length(n):
    """The uses of all pieces spell the word, and short and long words are counted by one rule."""
    pieces = {"▁": math.log(0.1), "a": math.log(0.05), "ab": math.log(0.1), "b": math.log(0.07), "bab": math.log(0.02), "é": math.log(0.001)}
    lattice = lm_score.Lattice(pieces, [math.log(1e-4)] * 256)
    s = ("▁" + "abé漢" * n)[:n]
    uses = [0.0] * len(lattice.logp)
    lattice.expect(s, 3.0, uses)
    spelt = sum(u * len(p.encode()) for u, p in zip(uses, lattice.names, strict=False)) + sum(uses[lattice.bytes_at :])
    assert math.isclose(spelt, 3 * len(s.encode()), rel_tol=1e-9)
    if n <= 64:
        logs = [0.0] * len(lattice.logp)
        lattice._expect_long(s, 3.0, logs)
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-15) for x, y in zip(uses, logs, strict=True))


def test_whole_score_against_brute_force(spark):
    """Counts, one round of expectation maximisation and the forward recursion, all written out over every segmentation."""
    texts = ["Ab ab a", "ba b", "", None, "ab ba ab", "b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pieces, by_byte = lm_score.load_pieces(PIECES)

    def ways(w):
        if not w:
            return [[]]
        return [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in pieces for rest in ways(w[k:])]

    split = lambda t: (t or "").lower().split()
    train = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in split(t))
    ends = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts)))
    uses = Counter()
    for w, c in train.items():
        found = [(math.exp(sum(pieces[p] for p in way)), way) for way in ways("▁" + w)]
        for p, way in found:
            for x in way:
                uses[x] += c * p / sum(q for q, _ in found)
    whole = sum(uses.values()) + ends + 0.01 * (len(pieces) + 257)
    new = {p: math.log10((uses[p] + 0.01) / whole) for p in pieces}
    end = math.log10((ends + 0.01) / whole)
    for r in lm_score.score(docs, PIECES).collect():
        want = end + sum(math.log10(sum(10 ** sum(new[p] for p in way) for way in ways("▁" + w))) for w in split(texts[r["doc_id"]]))
        assert math.isclose(r["score"], want, rel_tol=1e-9)


def test_repeated_rows_and_clashing_columns_are_scored(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "w"), (1, "a b", 6, "w"), (3, "a " * 50_000, 7, "w")], "doc_id long, text string, row int, word string")
    got = lm_score.score(docs, PIECES).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(1, 3), (1, 3), (3, 50_001)]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_scores_count_words_exactly(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(900001, None), (900002, ""), (900003, "zzzqqq " * 3), (900004, "x" * 5000)], "doc_id long, text string"))
    rows = docs.collect()
    train = Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            train.update([*(r["text"] or "").encode().lower().split(), b"\n"])
    n, v = sum(train.values()), len(train)
    for head in (1 << 18, 5):
        got = {r["doc_id"]: r for r in lm_score.score(docs, PIECES, head_words=head).collect()}
        assert len(got) == len(rows)
        for r in rows:
            ts = [*(r["text"] or "").encode().lower().split(), b"\n"]
            g = got[r["doc_id"]]
            assert (g["n_tokens"], g["n_known"], g["train_tokens"], g["held_out"]) == (len(ts), sum(t in train for t in ts), n, zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
            assert math.isclose(g["base_score"], sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
            assert g["score"] < 0 and math.isfinite(g["score"])


def test_score_prefers_real_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("lang = 'en'")
    text = next(r["text"] for r in docs.collect() if len(r["text"]) > 500)
    letters = list(text)
    random.Random(1).shuffle(letters)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs.unionByName(spark.createDataFrame([(900001, text), (900002, "".join(letters))], "doc_id long, text string")), PIECES).collect()}
    assert got[900001] > got[900002]


def test_no_rows_to_score(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(none, PIECES).count() == 0
    null_id = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = lm_score.score(null_id, PIECES).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0) and r["base_score"] == 0


def toxic_rows():
    rnd = random.Random(7)
    syllables = ["ta", "ri", "mo", "ne", "lu", "so"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.choice([1, 2, 3])))
    rows = []
    for i in range(600):
        ws = [word() for _ in range(rnd.choice([8, 40, 200]))]
        y = int(rnd.random() < 0.2)
        if y:
            for _ in range(1 + len(ws) // 25):
                ws[rnd.randrange(len(ws))] = "grk" + rnd.choice(["ash", "ush", "osh"]) + rnd.choice(syllables)
        rows.append((i, " ".join(ws), y))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t, _ in rows] + [(None, None, "c", 1), (7001, "", "c", 1), (7001, "", "c", 1)], "doc_id long, text string, y string, half int")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(0, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    truth = {i: y for i, _, y in rows}
    got = toxicity.score(docs, model).collect()
    assert len(got) == 603 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns
    kept = {r["doc_id"] for r in left.collect()}
    assert {7001, None} <= kept and sum(truth.get(i, 0) for i in kept) <= 6
    one_class = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert toxicity.score(docs, one_class).filter("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_of_very_long_texts(spark):
    rows = toxic_rows()[:200]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    clean, toxic = next(t for _, t, y in rows if not y), next(t for _, t, y in rows if y)
    long = spark.createDataFrame([(1, clean * 20_000), (2, (toxic + " ") * 20_000), (3, "x" * 3_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(long, model).collect()}
    assert got[1] < 0.3 <= got[2] and 0 <= got[3] <= 1


def test_toxicity_weights_stand_for_the_labelled_ids(spark, monkeypatch):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, y) for i, _, y in rows[:50]] + [(i, 0) for i in range(9000, 9100)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, t) for i, t, _ in rows[:5]], "doc_id long, text string")
    n = {y: sum(v == y and not held(i) for i, _, v in rows) for y in (0, 1)}
    seen = []
    own = toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda x, y, weight: seen.append(dict(zip(y.tolist(), weight.tolist(), strict=True))) or own(x, y, weight))
    for most in (n[1] - 10, n[1] + 1, n[0], 10_000):
        toxicity.fit(texts, labels, max_per_class=most)
        assert seen.pop() == {float(y): n[y] / min(n[y], most) for y in (0, 1)}


def test_held_out_labels_change_nothing(spark):
    """Whether the sample takes all rows or some, other labels of the held-out fold give equal scores."""
    rows = toxic_rows()[:300]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y
    for most in (30, 10_000):
        models = [toxicity.fit(docs, spark.createDataFrame([(i, f(i, y)) for i, _, y in rows], "doc_id long, toxic int"), max_per_class=most) for f in (lambda i, y: y, flip)]
        assert (models[0].noise, models[0].slope, models[0].bias) == (models[1].noise, models[1].slope, models[1].bias)
        assert models[0].ratio == models[1].ratio


def test_kneser_ney_against_brute_force():
    """Every log ratio of words seen and unseen, from the formula written out over lists of n-grams."""
    order, d = 3, 0.75
    seen = {0: ["abab", "abc", "b", "cab"] * 2, 1: ["xab", "xax", "abx"]}
    cut = {y: [s[i - order : i] for w in ws for s in [toxicity.padded(w, order)] for i in range(order, len(s) + 1)] for y, ws in seen.items()}
    levels = {order: set(cut[0]) | set(cut[1])}
    for k in range(order - 1, 0, -1):
        levels[k] = {g[1:] for g in levels[k + 1]}

    def shared(g):
        if not g:
            return 1 / (len(levels[1]) + 256)
        before = lambda x: sum(u[1:] == x for u in levels[len(x) + 1])
        all_after = [x for x in levels[len(g)] if x[:-1] == g[:-1]]
        total = sum(map(before, all_after))
        return (max(before(g) - d, 0) + d * len(all_after) * shared(g[1:])) / total if total else shared(g[1:])

    def prob(y, g):
        after = [x for x in cut[y] if x[:-1] == g[:-1]]
        return (max(after.count(g) - d, 0) + d * len(set(after)) * shared(g[1:])) / len(after) if after else shared(g[1:])

    model = toxicity.Model([(g, cut[0].count(g), cut[1].count(g)) for g in levels[order]], order)
    for w in ("abab", "xab", "xxb", "zzz", "", "bca", "abx"):
        s = toxicity.padded(w, order)
        grams = [s[i - order : i] for i in range(order, len(s) + 1)]
        assert math.isclose(model.word(w.encode()), sum(math.log(prob(1, g) / prob(0, g)) for g in grams), abs_tol=1e-9)
    # Probabilities after any history sum to one over the seen characters and the 256 others.
    for h in ("ab", "xa", "qq", toxicity.START * 2):
        chars = sorted({g for g in levels[1]})
        rest = shared("\u1234") * 256
        for y in (0, 1):
            unseen = prob(y, h + "\u1234") * 256
            assert math.isclose(sum(prob(y, h + c) for c in chars) + unseen, 1) and rest > 0


def test_noise_has_the_least_loss_on_the_given_rows():
    rnd = random.Random(3)
    y = [int(rnd.random() < 0.3) for _ in range(400)]
    import numpy as np

    x = np.array([[rnd.gauss(0, 3)] * (len(toxicity.NOISES) - 1) + [2.0 * v + rnd.gauss(0, 0.3)] for v in y])
    assert toxicity.choose(x, np.array(y, dtype=float), np.ones(400))[0] == toxicity.NOISES[-1]
    same = np.repeat(x[:, -1:], len(toxicity.NOISES), axis=1)
    assert toxicity.choose(same, np.array(y, dtype=float), np.ones(400))[0] == toxicity.NOISES[0]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    assert sorted(tuple(str(r[c]) for c in order) for r in got.collect()) == sorted(tuple(str(r[names.index(c)]) for c in order) for r in want.fetchall())


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at
        at = stage(spark, before, sf).cache()
        assert at.columns == docs.columns, name
        assert 0 < at.count() <= before.count()
    texts = [r["text"] for r in at.collect()]
    assert len({t.lower() for t in texts}) == len(texts)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    built = decontaminate.Automaton([(r["item_id"], decontaminate.words(r["text"])) for r in bench], 10)
    assert not any(built.scan(decontaminate.words(t))[0] for t in texts)
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == len(texts)


def cut_by_hand(text, windows, limit):
    """The text without hit words, until none is; None if over half of them are hit at first, or all at last."""
    while True:
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text)))
        ws = [m[0] for m in found]
        sizes = {len(win) for win in windows}
        hit = sorted({k for n in sizes for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows for k in range(i, i + n)})
        if not hit:
            return text
        if len(hit) > limit * len(ws) or len(hit) == len(ws):
            return None
        limit, kept, done = 1.0, [], 0
        for k in hit:
            if k - 1 not in hit:
                kept.append(text[done : found[k].start()])
            done = found[k].end()
        text = "".join([*kept, text[done:]])


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    """Every stage over again by hand, on the given table with null ids and texts, repeated rows and columns of clashing names."""
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest table has too few labels to reject anything
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    given = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in given.collect()]
    t = " ".join(f"word{i}" for i in range(50))
    more = [(None, t), (None, t), (9001, None), (9002, ""), (9003, t.upper()), (9003, t.upper()), (9004, t + " more"), (9005, bench[0] + " " + " ".join(f"clean{i}" for i in range(80))), (9006, bench[1]), (None, "another text without an id")]
    rows += [rows[3], rows[3]] + [(i, x, "en", "web", len(x or "")) for i, x in more]
    assert given.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clash = spark.createDataFrame(rows, given.schema).selectExpr("*", "1 AS row", "'x' AS h", "2L AS n", "'c' AS items", "true AS kept", "'t' AS __spans")
    clash.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = toxicity.fit(clash, spark.read.parquet(f"{sf}/labels.parquet"))
    left = [(i, x, n) for i, x, _, _, n in rows if not decontaminate.words(x) or model.probability(model.mean(decontaminate.words(x))) < 0.3]
    assert len(left) < len(rows)
    of_text = {}
    for r in left:
        k = low(r[1])
        if k not in of_text or (r[0] is not None, r[0] or 0) > (of_text[k][0] is not None, of_text[k][0] or 0):
            of_text[k] = r
    left = list(of_text.values())
    groups = {}
    for k, _, root, _ in brute([(k, r[1]) for k, r in enumerate(left)]):
        groups.setdefault(root, []).append(left[k])
    left = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    split = [tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(x))) for x in bench if x]
    windows = {ws[i : i + min(10, len(ws))] for ws in split if ws for i in range(max(1, len(ws) - 9))}
    want = {}
    for i, x, _ in left:
        x = x if x is None else cut_by_hand(x, windows, 0.5)
        if x is not None or i == 9001:
            ids = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))(x or "")
            want.setdefault(i, []).append(len(ids) + 1)
    got = {}
    for r in packed:
        got.setdefault(r["doc_id"], {}).setdefault(r["doc_tokens"], 0)
        got[r["doc_id"]][r["doc_tokens"]] += r["length"]
    assert {i: sorted(k for k in v) for i, v in got.items()} == {i: sorted(set(v)) for i, v in want.items()}
    assert all(total % tokens == 0 for v in got.values() for tokens, total in v.items())


def test_pipeline_on_no_rows(spark, sf):
    at = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
    assert at.count() == 0
