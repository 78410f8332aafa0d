import pytest
from pyspark.sql import functions as F

from quillmesh.operators import partition


def samples(spark, fire, nofire):
    return spark.range(fire + nofire).select("id", F.when(F.col("id") < fire, "Fire").otherwise("No_Fire").alias("class"))


def sizes(df):
    return {(r["node"], r["class"]): r["n"] for r in df.groupBy("node", "class").agg(F.count("*").alias("n")).collect()}


def test_recorded_sizes(spark):
    s = samples(spark, 30155, 17837)
    got = sizes(partition.iid(s))
    assert [got[f"node_{n}", "Fire"] for n in "abc"] == [10052, 10052, 10051]
    assert [got[f"node_{n}", "No_Fire"] for n in "abc"] == [5946, 5946, 5945]
    got = sizes(partition.label_skew(s))
    assert [(got[f"node_{n}", "Fire"], got[f"node_{n}", "No_Fire"]) for n in "abc"] == [(12797, 3200), (14158, 1840), (3200, 12797)]


@pytest.mark.parametrize(("fire", "nofire"), [(51, 348), (348, 51), (1, 5), (7, 0)])
def test_skew_is_disjoint_and_complete(spark, fire, nofire):
    got = partition.label_skew(samples(spark, fire, nofire)).collect()
    assert sorted(r["id"] for r in got) == list(range(fire + nofire))


def test_split_boundary_is_a_double_product(spark):
    parts = samples(spark, 90, 0).withColumn("node", F.lit("node_a"))
    got = {r["split"]: r["count"] for r in partition.split(parts).groupBy("split").count().collect()}
    assert got == {"train": 62, "val": 14, "test": 14}


def test_split_is_stable_and_disjoint(spark):
    parts = partition.iid(samples(spark, 200, 100))
    a, b = ({r["id"]: r["split"] for r in partition.split(parts.repartition(n)).collect()} for n in (1, 7))
    assert a == b
    assert len(a) == 300


def test_positions_equal_a_plain_sort(spark):
    s = samples(spark, 500, 37)
    key = F.md5(F.col("id").cast("string"))
    got = {r["id"]: (r["pos"], r["size"]) for r in partition.ranked(s, ["class"], key, "id").collect()}
    import hashlib

    for low, high in ((0, 500), (500, 537)):
        want = sorted(range(low, high), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert all(got[i] == (k, high - low) for k, i in enumerate(want))


def test_overwriting_leaves_no_union(spark, tmp_path):
    for nodes in (2, 3):
        partition.write_splits(partition.split(partition.iid(samples(spark, 30, 30), nodes)).withColumn("dist", F.lit("iid")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 60
