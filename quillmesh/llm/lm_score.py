"""Language-model scores from a subword lattice: an existing vocabulary, piece weights estimated on the corpus, and the
marginal probability of a text over all its segmentations by a forward recursion in log space.

Pieces never cross words, so a text's lattice is a product over its words, and each distinct word is solved once. Frequent
words (a proven bound: at most N / t words occur t times or more) ride along in a broadcast; the rest join by a shuffle.

The vocabulary's own scores are merge ranks. They become starting weights 1 / (rank + 50), and rounds of expectation
maximisation over all distinct training words turn them into unigram probabilities; no piece is added or removed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import batch_of, fold, written

END = b"\n"  # stands for the end token; no word holds white space
SPACE = "▁"
NONE = -1e300
PLAIN = 64


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, in UTF-8, without the end token."""
    return (text or "").encode().lower().split()


def load_pieces(path: str) -> tuple[dict[str, float], list[float]]:
    """Starting log weights of the pieces that can lie in a word, and of the 256 byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, size = {}, model.get_piece_size()
    for k in range(size):
        piece = model.id_to_piece(k)
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or SPACE in piece[1:]):
            pieces[piece] = -math.log(50 - max(model.get_score(k), -float(size)))
    lowest = min(pieces.values()) - math.log(size)
    total = math.log(sum(map(math.exp, pieces.values())) + 256 * math.exp(lowest))
    return {p: v - total for p, v in pieces.items()}, [lowest - total] * 256


class Lattice:
    def __init__(self, pieces: dict[str, float], by_byte: list[float]):
        self.names = list(pieces)
        self.logp = list(pieces.values()) + by_byte
        self.p = [math.exp(v) for v in self.logp]
        self.bytes_at = len(self.names)
        self.longest = max(map(len, self.names), default=1)
        self.trie: dict = {}
        for k, name in enumerate(self.names):
            node = self.trie
            for c in name:
                node = node.setdefault(c, {})
            node[""] = k

    def arcs(self, s: str) -> list[list[tuple[int, tuple[int, ...]]]]:
        """For each start, the pieces that fit: (end, piece numbers). A character that is no piece is spelt in bytes."""
        out = []
        for i in range(len(s)):
            node, here = self.trie, []
            for j in range(i, len(s)):
                node = node.get(s[j])
                if node is None:
                    break
                k = node.get("")
                if k is not None:
                    here.append((j + 1, (k,)))
            if not here or here[0][0] != i + 1:
                here.append((i + 1, tuple(self.bytes_at + b for b in s[i].encode())))
            out.append(here)
        return out

    def forward(self, arcs: list[list[tuple[int, tuple[int, ...]]]]) -> list[float]:
        """Log of the sum over all segmentations of each prefix."""
        logp, exp, log1p = self.logp, math.exp, math.log1p
        a = [NONE] * (len(arcs) + 1)
        a[0] = 0.0
        for i, here in enumerate(arcs):
            ai = a[i]
            for j, ks in here:
                x = ai + (logp[ks[0]] if len(ks) == 1 else sum(logp[k] for k in ks))
                y = a[j]
                a[j] = x if y == NONE else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
        return a

    def log_prob(self, s: str) -> float:
        """Log of the sum over all segmentations."""
        return self.forward(self.arcs(s))[-1]

    def expect(self, s: str, n: float, into: list[float]) -> None:
        """Adds the expected uses of each piece in ``n`` words ``s``, whatever their length.

        Sums of short words fit into plain numbers, which is faster; those of longer words are kept as logs. Both are exact.
        """
        (self._expect_short if len(s) <= PLAIN else self._expect_long)(s, n, into)

    def _expect_short(self, s: str, n: float, into: list[float]) -> None:
        p, arcs, size = self.p, self.arcs(s), len(s)
        a, b, weights = [1.0] + [0.0] * size, [0.0] * size + [1.0], []
        for i, here in enumerate(arcs):
            ai, ws = a[i], []
            for j, ks in here:
                # Times ten a character: keeps the sums near one, and cancels in the ratio below.
                w = (p[ks[0]] if len(ks) == 1 else math.prod([p[k] for k in ks])) * 10.0 ** (j - i)
                ws.append(w)
                a[j] += ai * w
            weights.append(ws)
        share = n / a[size]
        for i in range(size - 1, -1, -1):
            left, bi = a[i] * share, 0.0
            for w, (j, ks) in zip(weights[i], arcs[i], strict=True):
                x = w * b[j]
                bi += x
                for k in ks:
                    into[k] += left * x
            b[i] = bi

    def _expect_long(self, s: str, n: float, into: list[float]) -> None:
        arcs = self.arcs(s)
        a, logp = self.forward(arcs), self.logp
        b = [NONE] * len(s) + [0.0]
        for i in range(len(s) - 1, -1, -1):
            xs = [sum(logp[k] for k in ks) + b[j] for j, ks in arcs[i]]
            top = max(xs)
            b[i] = top + math.log(math.fsum(math.exp(x - top) for x in xs))
            for x, (_, ks) in zip(xs, arcs[i], strict=True):
                share = n * math.exp(a[i] + x - a[-1])
                for k in ks:
                    into[k] += share


def _count_task():
    schema = pa.schema([("word", pa.binary()), ("n_train", pa.int64()), ("n_other", pa.int64())])

    def flush(train: Counter, other: Counter) -> pa.RecordBatch:
        keys = list(train.keys() | other.keys())
        return batch_of(schema, keys, [train[k] for k in keys], [other[k] for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()
        for batch in batches:
            for text, out in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                into = other if out else train
                into.update(tokens(text.as_py()))
                into[END] += 1
            if len(train) + len(other) > 500_000:
                yield flush(train, other)
                train, other = Counter(), Counter()
        yield flush(train, other)

    return run


def _expect_task(shared):
    schema = pa.schema([("piece", pa.int32()), ("uses", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        uses = [0.0] * len(lattice.logp)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word != END:
                    lattice.expect(SPACE + word.decode(), n, uses)
        found = [k for k, v in enumerate(uses) if v > 0]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([uses[k] for k in found], pa.float64())], schema=schema)

    return run


def _word_task(shared):
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("n", pa.int64()), ("logp", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *model, end = shared.value
        lattice = Lattice(*model)
        for batch in batches:
            logs = [end if x == END else lattice.log_prob(SPACE + x.decode()) / math.log(10) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(logs, pa.float64())], schema=schema)

    return run


def _score_task(shared, base: float):
    """Sums over the frequent words; the others are listed for the join."""
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base", pa.float64()), ("logp", pa.float64()), ("rest", pa.list_(pa.binary())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, row = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for text, held, doc in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ws = tokens(text.as_py())
                ws.append(END)
                got = list(map(head.get, ws))
                hit = [x for x in got if x is not None]
                rest = [w for w, x in zip(ws, got, strict=True) if x is None] if len(hit) < len(got) else []
                out.append((row, doc, held, len(ws), sum(x[2] for x in hit), math.fsum(x[0] for x in hit), math.fsum(x[1] for x in hit), rest))
                row += 1
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    return run


def score(
    docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2,
    em_rounds: int = 1, head_words: int = 1 << 18, smoothing: float = 0.01,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each document.

    Learns from rows whose crc32(id as text) mod ``folds`` is not ``held_out``. Null and empty texts are the end token
    only. A null id counts as held out. Without training rows every weight is the vocabulary's own and base_score is of an
    empty count table. Repeated rows count and are scored each; other columns are ignored.
    """
    spark = docs.sparkSession
    part = F.coalesce(fold(F.col(f"`{id_col}`"), folds) == held_out, F.lit(True))
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), part.alias("held_out"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    counts = rows.select("text", "held_out").mapInArrow(_count_task(), "word binary, n_train long, n_other long")
    counts = written(counts.groupBy("word").agg(F.sum("n_train").alias("c"), (F.sum("n_train") + F.sum("n_other")).alias("n")), "lm-counts")
    total = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))).alias("ends")).first()
    n_train, v_train, ends = total["n"] or 0, total["v"] or 0, total["ends"] or 0
    pieces, by_byte = load_pieces(vocabulary_path)
    names, end = list(pieces), math.log(0.1)
    for _ in range(em_rounds if n_train else 0):
        # As many numbers as the vocabulary has pieces come back, whatever the corpus.
        shared = spark.sparkContext.broadcast((pieces, by_byte))
        uses = counts.filter("c > 0").select("word", "c").mapInArrow(_expect_task(shared), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        got = {r["piece"]: r["uses"] for r in uses.collect()}
        whole = sum(got.values()) + ends + smoothing * (len(names) + 257)
        logs = [math.log((got.get(k, 0.0) + smoothing) / whole) for k in range(len(names) + 256)]
        pieces, by_byte, end = dict(zip(names, logs, strict=False)), logs[len(names) :], math.log((ends + smoothing) / whole)
    model = spark.sparkContext.broadcast((pieces, by_byte, end / math.log(10)))
    known = written(counts.mapInArrow(_word_task(model), "word binary, c long, n long, logp double"), "lm-words")
    base = math.log10(n_train + v_train + 1)
    tokens_all = known.agg(F.sum("n")).first()[0] or 0
    least = max(1, tokens_all // (head_words * 8))
    while known.filter(F.col("n") >= least).count() > head_words:
        least *= 2
    head = {bytes(r["word"]): (math.log10(r["c"] + 1) - base, r["logp"], int(r["c"] > 0)) for r in known.filter(F.col("n") >= least).toLocalIterator()}
    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, logp double, rest array<binary>"
    partial = written(rows.mapInArrow(_score_task(spark.sparkContext.broadcast(head), base), kind), "lm-partial")
    rest = partial.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    tail = rest.join(known.filter(F.col("n") < least).select("word", "c", "logp"), "word")
    sums = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known2"),
        F.sum(F.col("k") * (F.log10(F.col("c") + 1) - F.lit(base))).alias("base2"),
        F.sum(F.col("k") * F.col("logp")).alias("logp2"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return partial.drop("rest").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known2")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2")).alias("base_score"), (F.col("logp") + zero("logp2")).alias("score"),
    )
