"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models, toxic and ordinary, have counts of their own at the highest order only; below, both share one Kneser-Ney
chain of continuation counts over both classes. So what neither class has evidence for cancels in the ratio, and a rare
or unseen word is judged by its parts. A text's score is the mean over its words of what their log ratios have beyond
``noise`` nats, calibrated by a logistic curve on the training rows; with a noise of 0 it is the plain difference of both
log-likelihoods, normalised by words. How much is noise (such as the difference between two languages, one of which has
more toxic texts) is chosen on the training rows: two halves score each other under each of ``NOISES``, and the one with the
least log loss is taken. Training rows are a bounded sample (``max_per_class`` of each class), each weighted by how many
labelled ids of its class it stands for; their n-grams are counted in Spark, and the fitted model, bounded by the sample, is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import batch_of, fold, only, positional, written
from quillmesh.llm.decontaminate import words

START, STOP = "\x02", "\x03"
CACHE = 300_000
NOISES = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic", folds: int = 4, held_out: int = 2) -> DataFrame:
    """id, y: labelled ids outside the held-out fold that have a document. Of ids labelled twice, toxic wins; null ids and labels are left out."""
    ids = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    ids = ids.filter(fold(F.col("id"), folds) != held_out).groupBy("id").agg(F.max("y").alias("y"))
    return ids.join(docs.select(F.col(f"`{id_col}`").cast("long").alias("id")).distinct(), "id", "left_semi")


def sample(ids: DataFrame, max_per_class: int = 10_000) -> tuple[DataFrame, dict[int, float]]:
    """At most ``max_per_class`` of the ``labelled`` ids of each class, by hash order, and how many ids of its class each stands for."""
    n = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    first = lambda y: ids.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_per_class)
    return first(0).unionByName(first(1)), {y: n[y] / min(n[y], max_per_class) for y in n}


def padded(word: str, order: int) -> str:
    return START * (order - 1) + word + STOP


def _count_task(order: int):
    """Counts of the highest-order character n-grams of either class; words are counted first, so each is cut once."""
    schema = pa.schema([("gram", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, grams = (Counter(), Counter()), (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[y].update(words(text.as_py()))
        for y in (0, 1):
            for word, n in seen[y].items():
                s = padded(word.decode(), order)
                for i in range(order, len(s) + 1):
                    grams[y][s[i - order : i]] += n
        keys = list(grams[0].keys() | grams[1].keys())
        yield batch_of(schema, keys, [grams[0][k] for k in keys], [grams[1][k] for k in keys])

    return run


class Model:
    """``ratio[h + c]``: log ratio of toxic over ordinary for character c after h; ``shift[h]`` where c was never seen after h."""

    def __init__(self, counts: list[tuple[str, int, int]], order: int = 5, discount: float = 0.75):
        self.order, self.noise, self.ratio, self.shift = order, 0.0, {}, {}
        self.slope, self.bias = 0.0, 0.0
        top = tuple(Counter({c[0]: c[1 + y] for c in counts if c[1 + y]}) for y in (0, 1))
        shared = self._shared(set(top[0]) | set(top[1]), order, discount)
        sums, kinds = (Counter(), Counter()), (Counter(), Counter())
        for y in (0, 1):
            for g, n in top[y].items():
                sums[y][g[:-1]] += n
                kinds[y][g[:-1]] += 1

        def prob(y: int, g: str) -> float:
            h, low = g[:-1], shared(g[1:])
            if not sums[y][h]:
                return low
            return (max(top[y][g] - discount, 0.0) + discount * kinds[y][h] * low) / sums[y][h]

        for g in set(top[0]) | set(top[1]):
            self.ratio[g] = math.log(prob(1, g) / prob(0, g))
        for h in set(sums[0]) | set(sums[1]):
            back = [discount * kinds[y][h] / sums[y][h] if sums[y][h] else 1.0 for y in (0, 1)]
            self.shift[h] = math.log(back[1] / back[0])
        self.words: dict[bytes, float] = {}

    @staticmethod
    def _shared(grams: set[str], order: int, discount: float):
        """Kneser-Ney below the highest order: each count is the number of different characters seen to the left."""
        levels: dict[int, tuple[Counter, Counter, Counter]] = {}
        for k in range(order - 1, 0, -1):
            left = Counter(g[1:] for g in grams)
            sums, kinds = Counter(), Counter()
            for g, n in left.items():
                sums[g[:-1]] += n
                kinds[g[:-1]] += 1
            levels[k], grams = (left, sums, kinds), set(left)
        floor = 1.0 / (len(levels[1][0]) + 256)

        def prob(g: str) -> float:
            p = floor
            for k in range(1, order):
                left, sums, kinds = levels[k]
                x = g[len(g) - k :]
                if total := sums[x[:-1]]:
                    p = (max(left[x] - discount, 0.0) + discount * kinds[x[:-1]] * p) / total
            return p

        return prob

    def word(self, w: bytes) -> float:
        """Log ratio of a word."""
        s, k, ratio, shift = padded(w.decode(), self.order), self.order, self.ratio, self.shift
        total = 0.0
        for i in range(k - 1, len(s)):
            r = ratio.get(s[i - k + 1 : i + 1])
            total += shift.get(s[i - k + 1 : i], 0.0) if r is None else r
        return total

    def means(self, ws: list[bytes], noises: tuple[float, ...] = NOISES) -> list[float]:
        """``mean`` under each noise."""
        if not ws:
            return [0.0] * len(noises)
        raw = np.array([self.word(w) for w in ws])
        return [float((np.sign(raw) * np.maximum(np.abs(raw) - noise, 0.0)).mean()) for noise in noises]

    def mean(self, ws: list[bytes]) -> float:
        """Length-normalised log ratio of a text beyond the noise of each word; 0 without words."""
        if not ws:
            return 0.0
        cache, got = self.words, []
        for w in ws:
            r = cache.get(w)
            if r is None:
                if len(cache) > CACHE:
                    cache.clear()
                r = self.word(w)
                r = cache[w] = math.copysign(max(abs(r) - self.noise, 0.0), r)
            got.append(r)
        return math.fsum(got) / len(got)

    def probability(self, x: float) -> float:
        z = max(-30.0, min(30.0, self.slope * x + self.bias))
        return 1.0 / (1.0 + math.exp(-z))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by Newton steps with a small ridge."""
    scale = max(float(np.abs(x).max(initial=0.0)), 1e-9)
    a = np.column_stack([x / scale, np.ones_like(x)])
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (weight * (y - p)) - 1e-3 * beta
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def choose(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """(noise, slope, bias) with the least log loss; ``x`` has a column for each of ``NOISES``. Ties go to the smaller noise."""
    found = []
    for k, noise in enumerate(NOISES):
        slope, bias = calibrate(x[:, k], y, weight)
        p = 1 / (1 + np.exp(-np.clip(slope * x[:, k] + bias, -30, 30)))
        loss = -float((weight * np.log(np.where(y == 1, p, 1 - p))).sum())
        found.append((round(loss, 9), noise, slope, bias))
    return min(found)[1:]


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held_out: int = 2,
    max_per_class: int = 10_000, order: int = 5,
) -> Model:
    """A model from the labelled rows outside the held-out fold. Two halves of the sample score each other for noise and calibration."""
    docs, labels = only(docs, id_col, text_col), only(labels, id_col, label_col)
    known = written(labelled(docs, labels, id_col=id_col, label_col=label_col, folds=folds, held_out=held_out), "toxicity-labelled")
    ids, weights = sample(known, max_per_class)
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # At most 2 * max_per_class ids: small enough to broadcast by its bound.
    rows = written(text.join(F.broadcast(ids), "id").select("text", "y", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))).cast("int").alias("half")), "toxicity-sample")
    kind = "gram string, n0 long, n1 long"
    halves = []
    for half in (0, 1):
        counts = rows.filter(F.col("half") == half).select("text", "y").mapInArrow(_count_task(order), kind).groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        halves.append([(r["gram"], r["n0"], r["n1"]) for r in counts.toLocalIterator()])
    both: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for half in halves:
        for g, a, b in half:
            both[g][0] += a
            both[g][1] += b
    model = Model([(g, *n) for g, n in both.items()], order)
    other = [rows.sparkSession.sparkContext.broadcast(Model(halves[1 - half], order)) for half in (0, 1)]

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [other[half].value.means(words(t.as_py())) for t, half in zip(batch.column(0), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    pairs = rows.select("text", "y", "half").mapInArrow(means, "x array<double>, y int").toPandas()
    took = set(pairs["y"])
    if len(took) == 2:
        y, weight = pairs["y"].to_numpy().astype(float), pairs["y"].map(weights).to_numpy(dtype=float)
        model.noise, model.slope, model.bias = choose(np.stack(pairs["x"].to_numpy()), y, weight)
    else:
        model.bias = -30.0 if 1 not in took else 30.0
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row. Null and empty texts have a mean ratio of 0; a null id counts as held out. Repeated rows get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [own.probability(own.mean(words(t.as_py()))) for t in batch.column(2)]
            yield batch_of(schema, batch.column(0), batch.column(1), got, [int(p >= threshold) for p in got])

    part = F.coalesce(fold(F.col(f"`{id_col}`"), folds) == held_out, F.lit(True))
    docs = only(docs, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), part.alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose score is below ``threshold``, as they are. Null and empty texts have nothing to reject and stay."""
    plain, (text,) = positional(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            stay = [not ws or own.probability(own.mean(ws)) < threshold for ws in (words(t.as_py()) for t in texts)]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
