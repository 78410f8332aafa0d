"""Local models, the round loop and the non-federated baselines.

Centroid models are relational from end to end. Iterative models train by steps: partial gradients of Arrow batches, summed by
an aggregate for each node, so that no task ever holds a node's samples. A user brings a ``LocalModel``, a ``Strategy`` with
its own ``aggregate``, a configuration for each round and a metric callback.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.expr import mu_of, squared_distance
from quillmesh.operators import metrics, weights


def pixels(samples: DataFrame, *keys: str) -> DataFrame:
    return samples.select(*keys, F.posexplode("x").alias("pos", "value"))


def centroids(samples: DataFrame, *keys: str) -> DataFrame:
    """Mean vector of each label, by keys: keys, label, pos, value, n."""
    return pixels(samples, *keys, "label").groupBy(*keys, "label", "pos").agg(F.avg(F.col("value").cast("double")).alias("value"), F.count("*").alias("n"))


def average_centroids(local: DataFrame) -> DataFrame:
    """Weighted by each node's examples of the label: label, pos, value."""
    return local.groupBy("label", "pos").agg(F.try_divide(F.sum(F.col("n") * F.col("value")), F.sum("n")).alias("value"))


def proximal_centroids(local: DataFrame, shared: DataFrame, mu: float) -> DataFrame:
    """Closed form of the proximal objective: (c + mu g) / (1 + mu)."""
    g = shared.select("label", "pos", F.col("value").alias("g"))
    return local.join(g, ["label", "pos"]).select("node", "label", "pos", ((F.col("value") + F.lit(mu) * F.col("g")) / F.lit(1 + mu)).alias("value"), "n")


def as_vectors(model: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: ``model`` = array of (label, vector) in label order. A model is as large as its labels times the width."""
    per_label = model.groupBy(*keys, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("c"))
    return per_label.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("model"))


BROADCAST_MODELS = 10_000


def predict(samples: DataFrame, models: DataFrame, pairs: Column | None = None) -> DataFrame:
    """Adds ``pred``, the label of the nearest centroid (the smaller label on ties), for every pair of sample and model row that ``pairs`` allows.

    Up to ``BROADCAST_MODELS`` models, a row each, ride in a broadcast; more are dealt to blocks of so many, and a sample meets
    the blocks one after the other.
    """
    far = F.transform("model", lambda m: F.struct(squared_distance(m["c"], F.col("x")).alias("d"), m["label"].alias("label")))
    blocks = max(1, -(-models.count() // BROADCAST_MODELS))
    names = [c for c in models.columns if c != "model"]
    models = models.withColumn("_block", F.pmod(F.xxhash64(*names), F.lit(blocks)) if names else F.lit(0))
    out = None
    for k in range(blocks):
        block = F.broadcast(models.filter(F.col("_block") == k).drop("_block"))
        met = samples.crossJoin(block) if pairs is None else samples.join(block, pairs)
        part = met.withColumn("pred", F.array_min(far)["label"]).drop("model")
        out = part if out is None else out.unionByName(part)
    return out


class LocalModel(Protocol):
    """What a client trains. Weights are a list of arrays, one for each layer; ``x`` has a row for each sample."""

    def initial(self) -> list[np.ndarray]:
        """The weights that every client starts with."""

    def gradients(self, weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients, summed over the samples."""

    def scores(self, weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        """A log score for each sample and class."""


@dataclass(frozen=True)
class Softmax:
    """Softmax regression: layer 0 is the matrix, layer 1 the bias."""

    classes: int = 10
    width: int = 64

    def initial(self) -> list[np.ndarray]:
        return [np.zeros((self.classes, self.width)), np.zeros(self.classes)]

    def scores(self, weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        z = x @ weights[0].T + weights[1]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        log_p = self.scores(weights, x)
        row = np.arange(len(y))
        loss, p = -float(log_p[row, y].sum()), np.exp(log_p)
        p[row, y] -= 1
        return loss, [p.T @ x, p.sum(axis=0)]


@dataclass(frozen=True)
class Strategy:
    """How a round aggregates. ``mu`` > 0 is proximal; ``keep_local`` names layers that never leave a node.

    Subclasses may override ``aggregate``.
    """

    name: str
    mu: float = 0.0
    keep_local: tuple[int, ...] = ()
    min_clients: int = 3

    def aggregate(self, local: DataFrame) -> DataFrame:
        """(node, n, layer, w) of all clients -> (node, layer, w) that each starts the next round with."""
        shared = weights.average(local).select("layer", F.col("w").alias("given"))
        own = F.col("layer").isin(list(self.keep_local)) if self.keep_local else F.lit(False)
        return local.join(shared, "layer").select("node", "layer", F.when(own, F.col("w")).otherwise(F.col("given")).alias("w"))


def strategy(name: str, min_clients: int = 3, keep_local: tuple[int, ...] = (1,)) -> Strategy:
    """fedavg, fedbn, fedprox (0.01), fedprox_<mu> or local (nothing leaves a node); unknown names are fedavg, bad weights 0.01."""
    if name.startswith("fedprox"):
        return Strategy(name, mu=mu_of(name), min_clients=min_clients)
    if name == "local":
        return Strategy(name, keep_local=(0, 1), min_clients=1)
    if name == "fedbn":
        return Strategy(name, keep_local=keep_local, min_clients=min_clients)
    return Strategy("fedavg", min_clients=min_clients)


@dataclass(frozen=True)
class FitConfig:
    """What the clients are told for a round."""

    epochs: int = 2
    batches: int = 2
    rate: float = 0.5


Models = dict[str, list[np.ndarray]]


def _partials(work: Callable[[list[np.ndarray], np.ndarray, np.ndarray], tuple], models: Models) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For each node in a task: examples, the sum that ``work`` gives, and its arrays' elements one after the other; one row leaves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for pdf in frames:
            for node, rows in pdf.groupby("node"):
                total, parts = work(models[node], np.stack(rows["x"].to_numpy()), rows["label"].to_numpy())
                flat = np.concatenate([p.ravel() for p in parts])
                n, before, sums = held.get(node, (0, 0.0, 0.0))
                held[node] = [n + len(rows), before + total, sums + flat]
        if held:
            n, total, parts = zip(*held.values(), strict=True)
            yield pd.DataFrame({"node": list(held), "n": n, "total": total, "parts": parts})

    return run


def _summed(samples: DataFrame, work, models: Models) -> dict[str, tuple[int, float, np.ndarray]]:
    """Sums over all samples of each node. A row for each node leaves a task, as wide as the model; what comes back is a model for each node."""
    rows = samples.select("node", "x", "label").mapInPandas(_partials(work, models), "node string, n long, total double, parts array<double>")
    both = F.concat(F.array(F.col("n").cast("double"), "total"), "parts")
    sums = weights.totals(rows.select("node", F.lit(1).alias("n"), F.lit(0).alias("layer"), both.alias("w")), "node")
    return {r["node"]: (round(r["sums"][0]), r["sums"][1], np.array(r["sums"][2:])) for r in sums.collect()}


def _layers(like: list[np.ndarray], flat: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum([w.size for w in like])
    return [part.reshape(w.shape) for w, part in zip(like, np.split(flat, ends[:-1]), strict=True)]


def fit(train: DataFrame, models: Models, model: LocalModel, config: FitConfig, mu: float) -> tuple[Models, dict[str, int], dict[str, float]]:
    """Trains every node's model: models, examples and mean loss by node.

    Each step is one Spark job over a batch of all nodes' samples, dealt by their order key, a hash in hex digits: partial gradients come
    from Arrow batches and are summed by an aggregate, so a node may have any number of samples. The optimiser is plain
    gradient descent and starts anew in every round; ``mu`` pulls towards the weights at the start.
    """
    start, now = models, models
    seen, lost = dict.fromkeys(models, 0), dict.fromkeys(models, 0.0)
    for _ in range(config.epochs):
        for k in range(config.batches):
            batch = train.filter(F.pmod(F.conv(F.substring("ord", 1, 4), 16, 10).cast("int"), F.lit(config.batches)) == k)
            after = dict(now)
            for node, (n, loss, flat) in _summed(batch, model.gradients, now).items():
                far = [w - w0 for w, w0 in zip(now[node], start[node], strict=True)]
                steps = _layers(now[node], flat)
                after[node] = [w - config.rate * (g / n + mu * d) for w, g, d in zip(now[node], steps, far, strict=True)]
                seen[node] += n
                lost[node] += loss + n * mu / 2 * sum(float((d**2).sum()) for d in far)
            now = after
    return now, {k: v // max(config.epochs, 1) for k, v in seen.items()}, {k: lost[k] / max(seen[k], 1) for k in seen}


def evaluate(samples: DataFrame, models: Models, model: LocalModel) -> DataFrame:
    """node, num_examples, loss, accuracy of each node's model on its samples."""

    def work(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        log_p = model.scores(weights, x)
        return -float(log_p[np.arange(len(y)), y].sum()), [np.array([(log_p.argmax(axis=1) == y).sum()], dtype=float)]

    found = _summed(samples, work, models)
    rows = [(node, n, loss / n, float(parts[0]) / n) for node, (n, loss, parts) in sorted(found.items())]
    return samples.sparkSession.createDataFrame(rows, "node string, num_examples long, loss double, accuracy double")


def as_rows(spark: SparkSession, models: Models, examples: dict[str, int]) -> DataFrame:
    """node, n, layer, w."""
    rows = [(node, examples[node], k, w.ravel().tolist()) for node, layers in sorted(models.items()) for k, w in enumerate(layers)]
    return spark.createDataFrame(rows, "node string, n long, layer int, w array<double>")


def run_rounds(
    samples: DataFrame, plan: Strategy, *, written: Callable[[DataFrame], DataFrame], model: LocalModel | None = None, rounds: int = 3,
    fit_config: Callable[[int], FitConfig] = lambda r: FitConfig(), evaluate_metrics: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Rounds over (node, split, label, ord, x): round, node, num_examples, train_loss, loss, accuracy; or what ``evaluate_metrics`` makes of these rows.

    The driver is the server: it holds one model for each node, never samples. ``written`` stores each round's results
    durably and reads them back. ``fit_config`` is asked before every round. A start with fewer than ``min_clients`` nodes
    raises; a node without samples in a batch keeps its weights.
    """
    spark, model = samples.sparkSession, model or Softmax()
    samples = written(samples.select("node", "split", "label", "ord", "x"))
    train, val = samples.filter("split = 'train'"), samples.filter("split = 'val'")
    nodes = sorted(r["node"] for r in train.select("node").distinct().collect())
    if len(nodes) < plan.min_clients:
        raise ValueError(f"{len(nodes)} nodes of {plan.min_clients} take part")
    models: Models = {node: model.initial() for node in nodes}
    out = None
    for r in range(1, rounds + 1):
        local, examples, losses = fit(train, models, model, fit_config(r), plan.mu)
        given = plan.aggregate(as_rows(spark, local, examples)).collect()
        models = {node: list(ws) for node, ws in local.items()}
        for row in given:
            models[row["node"]][row["layer"]] = np.array(row["w"]).reshape(local[row["node"]][row["layer"]].shape)
        trained = spark.createDataFrame(sorted(losses.items()), "node string, train_loss double")
        scored = evaluate(val.filter(F.col("node").isin(nodes)), models, model).join(trained, "node")
        done = written(scored.select(F.lit(r).alias("round"), "node", "num_examples", "train_loss", "loss", "accuracy"))
        out = done if out is None else out.unionByName(done)
    return evaluate_metrics(out) if evaluate_metrics else out


@dataclass(frozen=True)
class LocalConfig:
    """Local training of a round: passes over the samples, samples of a step, and the optimiser's (Adam's) settings."""

    epochs: int = 5
    batch: int = 8
    rate: float = 0.001
    decay: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8
    seed: int = 42
    part_rows: int = 50_000  # samples of a node that a task trains on


def local_epochs(x: np.ndarray, y: np.ndarray, order: list[str], start: list[np.ndarray], model: LocalModel, config: LocalConfig, mu: float, round_no: int) -> tuple[list[np.ndarray], float, int]:
    """Trains on one part of a node: weights, loss summed over samples, samples seen.

    Every epoch goes through the samples in an order of its own, by md5 of seed, round, epoch and the sample's order key. The
    moments start at zero in every round; with ``mu`` each step also pulls towards ``start``, and its loss says so.
    """
    now = [w.copy() for w in start]
    first, second = [np.zeros_like(w) for w in now], [np.zeros_like(w) for w in now]
    lost, seen, step = 0.0, 0, 0
    for epoch in range(config.epochs):
        keys = [md5(f"{config.seed}:{round_no}:{epoch}:{o}".encode()).hexdigest() for o in order]
        deal = sorted(range(len(keys)), key=keys.__getitem__)
        for at in range(0, len(deal), config.batch):
            rows = deal[at : at + config.batch]
            loss, gradients = model.gradients(now, x[rows], y[rows])
            far = [w - w0 for w, w0 in zip(now, start, strict=True)]
            lost += loss + len(rows) * mu / 2 * sum(float((d**2).sum()) for d in far)
            seen, step = seen + len(rows), step + 1
            for k, g in enumerate(gradients):
                g = g / len(rows) + mu * far[k]
                first[k] = config.decay[0] * first[k] + (1 - config.decay[0]) * g
                second[k] = config.decay[1] * second[k] + (1 - config.decay[1]) * g * g
                m, v = first[k] / (1 - config.decay[0] ** step), second[k] / (1 - config.decay[1] ** step)
                now[k] = now[k] - config.rate * m / (np.sqrt(v) + config.epsilon)
    return now, lost, seen


def _parts(samples: DataFrame, models: DataFrame, part_rows: int):
    """Samples and models by (node, part): a node's samples are dealt to parts of ``part_rows`` by their order key, each with the node's model."""
    sizes = samples.groupBy("node").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    dealt = samples.join(sizes, "node").withColumn("part", F.pmod(F.conv(F.substring("ord", 5, 6), 16, 10).cast("int"), F.col("parts")))
    given = models.join(sizes, "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("node", "part", "label", "ord", "x").groupBy("node", "part").cogroup(given.select("node", "part", "layer", "w").groupBy("node", "part"))


def _shaped(rows: pd.DataFrame, like: list[np.ndarray]) -> list[np.ndarray]:
    return [np.array(w, dtype=float).reshape(like[k].shape) for k, w in enumerate(rows.sort_values("layer")["w"])]


def fit_locally(train: DataFrame, models: DataFrame, model: LocalModel, config: LocalConfig, mu: float, round_no: int) -> DataFrame:
    """(node, label, ord, x) and (node, layer, w) -> node, part, n, layer, w, loss, seen: one job, each part trained where its samples are."""

    def work(key, rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or given.empty:
            return pd.DataFrame(columns=["node", "part", "n", "layer", "w", "loss", "seen"])
        rows = rows.sort_values("ord")
        start = _shaped(given, model.initial())
        trained, loss, seen = local_epochs(np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(), rows["ord"].tolist(), start, model, config, mu, round_no)
        n = len(rows)
        return pd.DataFrame([(key[0], key[1], n, k, w.ravel().tolist(), loss, seen) for k, w in enumerate(trained)], columns=["node", "part", "n", "layer", "w", "loss", "seen"])

    return _parts(train, models, config.part_rows).applyInPandas(work, "node string, part int, n long, layer int, w array<double>, loss double, seen long")


def score_locally(samples: DataFrame, models: DataFrame, model: LocalModel, part_rows: int = 50_000) -> DataFrame:
    """node, num_examples, loss, accuracy of each node's model on its samples."""

    def work(key, rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or given.empty:
            return pd.DataFrame(columns=["node", "n", "loss", "correct"])
        log_p, y = model.scores(_shaped(given, model.initial()), np.stack(rows["x"].to_numpy())), rows["label"].to_numpy()
        return pd.DataFrame([(key[0], len(y), -float(log_p[np.arange(len(y)), y].sum()), int((log_p.argmax(axis=1) == y).sum()))], columns=["node", "n", "loss", "correct"])

    sums = _parts(samples, models, part_rows).applyInPandas(work, "node string, n long, loss double, correct long")
    total = sums.groupBy("node").agg(F.sum("n").alias("num_examples"), F.sum("loss").alias("loss"), F.sum("correct").alias("correct"))
    return total.select("node", "num_examples", F.try_divide("loss", "num_examples").alias("loss"), F.try_divide("correct", "num_examples").alias("accuracy"))


def local_rounds(
    samples: DataFrame, plan: Strategy, *, written: Callable[[DataFrame], DataFrame], model: LocalModel | None = None, rounds: int = 3, patience: int | None = None,
    fit_config: Callable[[int], LocalConfig] = lambda r: LocalConfig(), fit_metrics: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rounds of local epochs over (node, split, label, ord, x): (round, node, num_examples, train_loss, loss, accuracy; final node, layer, w).

    Models are a table (node, layer, w), never on the driver. A round is a training job whose parts are merged by their samples, an
    average, and a scoring job; each is written. With ``patience``, rounds end when the loss over all nodes has not
    fallen for so many of them. ``fit_metrics`` turns (round, node, n, train_loss) into what is joined to a round's rows by node.
    A start with fewer than ``min_clients`` nodes raises.
    """
    model = model or Softmax()
    samples = written(samples.select("node", "split", "label", "ord", "x"))
    train, val = samples.filter("split = 'train'"), samples.filter("split = 'val'")
    nodes = written(train.select("node").distinct())
    if (n := nodes.count()) < plan.min_clients:
        raise ValueError(f"{n} nodes of {plan.min_clients} take part")
    first = F.array(*[F.struct(F.lit(k).alias("layer"), F.lit(w.ravel().tolist()).cast("array<double>").alias("w")) for k, w in enumerate(model.initial())])
    models, out, best, waited = written(nodes.select("node", F.inline(first))), None, None, 0
    for r in range(1, rounds + 1):
        parts = written(fit_locally(train, models, model, fit_config(r), plan.mu, r))
        heads = parts.filter("layer = 0").groupBy("node").agg(F.sum("n").alias("n"), F.try_divide(F.sum("loss"), F.sum("seen")).alias("train_loss"))
        local = weights.average(parts, "node").join(heads.select("node", "n"), "node")
        models = written(plan.aggregate(local))
        scored = score_locally(val, models, model).join(heads, "node").withColumn("round", F.lit(r))
        extra = fit_metrics(heads.withColumn("round", F.lit(r))) if fit_metrics else None
        if extra is not None:
            scored = scored.join(extra.drop("round"), "node", "left")
        more = [c for c in extra.columns if c not in ("round", "node")] if extra is not None else []
        done = written(scored.select("round", "node", "num_examples", "train_loss", "loss", "accuracy", *more))
        out = done if out is None else out.unionByName(done)
        now = done.agg(metrics.weighted(F.col("loss"), F.col("num_examples"))).first()[0]
        waited = 0 if best is None or (now is not None and now < best) else waited + 1
        best = now if best is None or (now is not None and now < best) else best
        if patience is not None and waited >= patience:
            break
    return out, models


def summary(per_node: DataFrame) -> DataFrame:
    """Round metrics over all nodes, weighted by examples."""
    return metrics.aggregate_round(per_node, "round")


def centralized(samples: DataFrame) -> DataFrame:
    """All nodes' samples as one node's, duplicates kept."""
    return samples.withColumn("node", F.lit("all"))


def train_test_pairs(tests: DataFrame, pairs: DataFrame) -> DataFrame:
    """(train, test) pairs of a configuration, where a train name of ``fl_all`` stands for every node with a test set."""
    nodes = tests.select(F.col("node").alias("test")).distinct()
    named = pairs.filter("test IS NOT NULL").join(nodes, "test", "left_semi").select("train", "test")
    return named.unionByName(pairs.filter("train = 'fl_all' AND test IS NULL").select("train").crossJoin(F.broadcast(nodes))).distinct()
