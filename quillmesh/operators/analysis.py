"""Analysis of run results: convergence tables, differences, spread over seeds, rank statistics, the experiment matrix."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as w

from quillmesh.functions.expr import half_even


def convergence(runs: DataFrame, rounds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(run, round, accuracy) -> run, r1.., first, last, gain."""
    cols = [F.max(F.when(F.col("round") == r, F.col("accuracy"))).alias(f"r{r}") for r in rounds]
    out = runs.groupBy("run").agg(*cols, F.array_sort(F.collect_list(F.struct("round", "accuracy"))).alias("h"))
    at = lambda k: F.try_element_at("h", F.lit(k))["accuracy"]
    return out.withColumns({"first_acc": at(1), "last_acc": at(-1), "gain": at(-1) - at(1)}).drop("h")


def differences(runs: DataFrame) -> DataFrame:
    """Pairwise differences of (run, accuracy, minutes), each pair once; runs are few rows."""
    a, b = (runs.select(*[F.col(c).alias(f"{c}_{s}") for c in ("run", "accuracy", "minutes")]) for s in "ab")
    points, minutes = (F.col("accuracy_a") - F.col("accuracy_b")) * 100, F.col("minutes_a") - F.col("minutes_b")
    return a.join(b, F.col("run_a") < F.col("run_b")).select("run_a", "run_b", points.alias("diff_pp"), minutes.alias("diff_minutes"))


# 97.5 % quantiles of the t distribution for 1 to 30 degrees of freedom; beyond them that of the normal one.
T_QUANTILES = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052,
    2.048, 2.045, 2.042,
]


def over_seeds(runs: DataFrame, value: str = "accuracy") -> DataFrame:
    """run, n, mean, std, ci95: half width of the 95 % interval of the mean; null for a single seed."""
    out = runs.groupBy("run").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    t = F.when(F.col("n") > 1, F.coalesce(F.get(F.array(*map(F.lit, T_QUANTILES)), F.col("n").cast("int") - 2), F.lit(1.960)))
    return out.withColumn("ci95", t * F.col("std") / F.sqrt(F.col("n").cast("double")))


def final(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, round, accuracy, minutes) -> keys, accuracy and minutes of the last round: the points of time against accuracy."""
    last = runs.groupBy(*keys).agg(F.max_by(F.struct("accuracy", "minutes"), "round").alias("x"))
    return last.select(*keys, "x.accuracy", "x.minutes")


def side_by_side(finals: DataFrame, key: str, column: str, values: list) -> DataFrame:
    """(key, column, accuracy) -> key and a column of accuracies for each of ``values``: two nodes beside three, or node beside node."""
    return finals.groupBy(key).agg(*[F.avg(F.when(F.col(column) == v, F.col("accuracy"))).alias(f"{column}_{v}") for v in values])


def findings(rounds: DataFrame, named: list[tuple[str, str, int, str, int, str]]) -> DataFrame:
    """finding, value of each (name, run, round, other run, its round, measure) over (run, round, accuracy, minutes).

    Accuracy differences are in percentage points, minutes as they are. One pass, no join.
    """
    of = lambda run, r, m: F.max(F.when((F.col("run") == run) & (F.col("round") == r), F.col(m)))
    deltas = [F.struct(F.lit(name).alias("finding"), ((of(a, i, m) - of(b, j, m)) * (100 if m == "accuracy" else 1)).alias("value")) for name, a, i, b, j, m in named]
    return rounds.agg(F.array(*deltas).alias("d")).select(F.inline("d"))


def poisson_weight(key: Column, replicate: Column, largest: int = 8) -> Column:
    """How often a row is drawn in a replicate: Poisson(1) by inversion of a number from the md5 of (replicate, key)."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", replicate.cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    below, term, steps = 0.0, exp(-1), []
    for k in range(largest):
        below += term
        steps.append((u >= below).cast("int"))
        term /= k + 1
    return sum(steps[1:], steps[0])


def bootstrap(rows: DataFrame, key: str, value: str, *groups: str, replicates: int = 20, level: float = 0.9) -> DataFrame:
    """groups, n, mean, low, high: the mean of ``value`` with a Poisson bootstrap interval.

    A row's draws depend on its key alone, so one pass with map-side sums gives all replicates: what is shuffled is a row for each
    group, replicate and task, and any order or partitioning gives the same interval.
    """
    drawn = rows.filter(F.col(value).isNotNull()).select(*groups, F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("_b"))
    weight = F.when(F.col("_b") == 0, 1).otherwise(poisson_weight(F.col("_k"), F.col("_b")))  # replicate 0 is the sample itself
    sums = drawn.withColumn("_w", weight).groupBy(*groups, "_b").agg(F.sum("_w").alias("w"), F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("m"))
    means = F.when(F.col("_b") > 0, F.col("m"))
    edge = (1 - level) / 2
    first = lambda c: F.max(F.when(F.col("_b") == 0, F.col(c)))
    return sums.groupBy(*groups).agg(first("w").alias("n"), first("m").alias("mean"), F.percentile(means, edge).alias("low"), F.percentile(means, 1 - edge).alias("high"))


def friedman(runs: DataFrame) -> DataFrame:
    """Extension: mean rank of each run over seeds, and the Friedman statistic over all."""
    ranked = runs.withColumn("r", F.rank().over(w.Window.partitionBy("seed").orderBy(F.desc("accuracy"))))
    means = ranked.groupBy("run").agg(F.avg("r").alias("mean_rank"), F.count("*").alias("n"))
    k, n = F.count("*").over(w.Window.partitionBy("one")), F.max("n").over(w.Window.partitionBy("one"))
    squares = F.sum(F.col("mean_rank") * F.col("mean_rank")).over(w.Window.partitionBy("one"))
    stat = F.lit(12.0) * n / (k * (k + 1)) * (squares - k * (k + 1) * (k + 1) / 4.0)
    return means.withColumn("one", F.lit(1)).select("run", "mean_rank", half_even(stat, 6).alias("statistic"))


def cohens_d(runs: DataFrame) -> DataFrame:
    """Extension: standardised difference of means of each pair of runs."""
    m = runs.groupBy("run").agg(F.count("*").alias("n"), F.avg("accuracy").alias("m"), F.var_samp("accuracy").alias("v"))
    a, b = (m.select(*[F.col(c).alias(f"{c}_{s}") for c in m.columns]) for s in "ab")
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    return a.join(b, F.col("run_a") < F.col("run_b")).select("run_a", "run_b", F.try_divide(F.col("m_a") - F.col("m_b"), pooled).alias("d"))


def open_runs(strategies: DataFrame, dists: DataFrame, seeds: DataFrame, done: DataFrame) -> DataFrame:
    """All combinations without the finished ones. The three lists are configuration, not data."""
    return strategies.crossJoin(dists).crossJoin(seeds).join(done, ["strategy", "dist", "seed"], "left_anti")
