import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import expr
from quillmesh.functions.expr import strategy_mu
from quillmesh.operators import analysis, federate, metrics, partition, weights

KIND = "node string, n int, layer int, w array<double>"


def values(df):
    return {(r["layer"], r["pos"]): r["value"] for r in df.collect()}


def test_weighted_average(spark):
    p = spark.createDataFrame([("a", 1, 0, [1.0, 2.0]), ("b", 3, 0, [3.0, 4.0])], KIND)
    assert values(weights.fedavg(p)) == {(0, 0): 2.5, (0, 1): 3.5}


def test_no_examples_is_null(spark):
    p = spark.createDataFrame([("a", 0, 0, [1.0])], KIND)
    assert values(weights.fedavg(p)) == {(0, 0): None}


def test_identical_weights_are_kept(spark):
    p = spark.createDataFrame([(n, 5, 0, [1.5, -2.0]) for n in "abc"], KIND)
    assert values(weights.fedavg(p)) == {(0, 0): 1.5, (0, 1): -2.0}


def test_normalisation_layers_stay_local(spark):
    p = spark.createDataFrame([("b", 1, 0, [1.0]), ("a", 1, 0, [3.0]), ("b", 1, 1, [10.0]), ("a", 1, 1, [20.0])], KIND)
    bn = spark.createDataFrame([(1,)], "layer int")
    assert values(weights.fedbn(p, bn)) == {(0, 0): 2.0, (1, 0): 20.0}
    shared = weights.assemble(weights.fedavg(p))
    got = {(r["node"], r["layer"]): r["w"] for r in weights.load(p, shared, bn).collect()}
    assert got == {("a", 0): [2.0], ("b", 0): [2.0], ("a", 1): [20.0], ("b", 1): [10.0]}


def test_proximal_term(spark):
    local = spark.createDataFrame([("a", 0, [1.0, 2.0])], "node string, layer int, w array<double>")
    shared = spark.createDataFrame([(0, [0.0, 0.0])], "layer int, w array<double>")
    assert abs(weights.proximal(local, shared, 0.01).first()["prox"] - 0.025) < 1e-12
    assert weights.proximal(local, local.select("layer", "w"), 5.0).first()["prox"] == 0


def test_strategies():
    assert federate.strategy("fedprox").mu == 0.01
    assert federate.strategy("fedprox_0.1").mu == 0.1
    assert federate.strategy("unknown").name == "fedavg"
    assert federate.strategy("fedbn").keep_local == (1,)


def test_expressions(spark):
    row = spark.range(1).select(
        expr.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a"), expr.widen_channels(F.array(F.lit(1.0), F.lit(2.0), F.lit(6.0)), 3, 5).alias("w"),
        expr.half_even(F.lit(0.0625), 3).alias("r"), expr.class_of_path(F.lit("x/NoFire/y.png")).alias("c"), expr.is_image(F.lit("A.JPG")).alias("i"), expr.strategy_mu(F.lit("fedprox_0.1")).alias("m"),
    ).first()
    assert (row["a"], row["w"], row["r"], row["c"], row["i"], row["m"]) == (1, [1.0, 2.0, 6.0, 3.0, 3.0], 0.062, "No_Fire", True, 0.1)


def test_rounds_need_clients(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "round int, node string")
    assert [r["round"] for r in metrics.ready(m, 2).collect()] == [1]


def _samples(spark):
    rows = [(n, split, y, f"{i:04x}", [float(y), 1.0, float(i % 3)]) for i, (n, split, y) in enumerate([(n, s, y) for n in "ab" for s in ("train", "val") for y in (0, 1) for _ in range(6)])]
    return spark.createDataFrame(rows, "node string, split string, label int, ord string, x array<double>")


def test_own_model_strategy_configuration_and_metrics(spark):
    """A user's model, aggregate, configuration for each round and metric callback take part."""
    asked = []

    class Constant:
        def initial(self):
            return [np.zeros(2)]

        def gradients(self, w, x, y):
            return float(len(y)), [np.array([-1.0, 0.0]) * len(y)]

        def scores(self, w, x):
            return np.repeat(w[0][None, :], len(x), axis=0)

    class First(federate.Strategy):
        def aggregate(self, local):
            top = local.filter("node = 'a'").select("layer", F.transform("w", lambda v: v * 10).alias("w"))
            return local.select("node", "layer").join(top, "layer").select("node", "layer", "w")

    def config(r):
        asked.append(r)
        return federate.FitConfig(epochs=r, batches=1, rate=1.0)

    out = federate.run_rounds(
        _samples(spark), First("first", min_clients=2), written=lambda df: df.cache(), model=Constant(), rounds=2, fit_config=config,
        evaluate_metrics=lambda per_node: per_node.groupBy("round").agg(F.max("loss").alias("loss"), F.sum("num_examples").alias("n")),
    )
    got = {r["round"]: (r["loss"], r["n"]) for r in out.collect()}
    # Weights go 0 -> 1 -> 10 in the first round, 10 -> 12 -> 120 in the second; half of the labels are 1.
    assert asked == [1, 2] and got == {1: (-5.0, 24), 2: (-60.0, 24)}
    with pytest.raises(ValueError):
        federate.run_rounds(_samples(spark), federate.strategy("fedavg"), written=lambda df: df, model=Constant())


def test_strategy_names_agree_with_the_column_form(spark):
    names = ["fedavg", "fedprox", "fedprox_0.1", "fedprox_x", "local"]
    got = spark.createDataFrame([(n,) for n in names], "s string").select(strategy_mu(F.col("s")).alias("mu")).collect()
    assert [r["mu"] for r in got] == [federate.strategy(n).mu for n in names] == [0.0, 0.01, 0.1, 0.01, 0.0]


def test_loaded_weights_keep_their_type(spark):
    local = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [2.0])], "node string, layer int, w array<float>")
    shared = spark.createDataFrame([(0, [5.0]), (1, [6.0])], "layer int, w array<double>")
    got = weights.load(local, shared, spark.createDataFrame([(1,)], "layer int"))
    assert got.schema["w"].dataType == local.schema["w"].dataType and sorted(map(tuple, got.collect())) == [("a", 0, [5.0]), ("a", 1, [2.0])]


def test_spread_of_any_number_of_seeds(spark):
    runs = spark.createDataFrame([("one", 1.0)] + [("two", float(i)) for i in range(2)] + [("many", float(i)) for i in range(40)], "run string, accuracy double")
    got = {r["run"]: (r["n"], r["ci95"], r["std"]) for r in analysis.over_seeds(runs).collect()}
    assert got["one"][1] is None and abs(got["two"][1] - 12.706 * got["two"][2] / 2**0.5) < 1e-9 and abs(got["many"][1] - 1.96 * got["many"][2] / 40**0.5) < 1e-9


def test_skew_over_more_nodes(spark):
    samples = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "Fire").otherwise("No_Fire").alias("class"))
    got = {(r["node"], r["class"]): r["count"] for r in partition.label_skew(samples, 5).groupBy("node", "class").count().collect()}
    assert sum(got.values()) == 1000 and got["node_a", "Fire"] == 160 and got["node_a", "No_Fire"] == 40 and got["node_e", "No_Fire"] == 160 and got["node_e", "Fire"] == 40
    assert all(got[n, c] == 100 for n in ("node_b", "node_c", "node_d") for c in ("Fire", "No_Fire"))
