"""Block averages, local epochs, weight versions, numbered logs, alignment in time, intervals, core rows, and stateful streams."""

import datetime as dt
import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import analysis, federate, frames, power, weights
from quillmesh.plans import stand_ins
from quillmesh.sources import files
from quillmesh.sources.shared import shared_folder, stored
from quillmesh.streaming import streams


@pytest.mark.parametrize("block", [1, 2, 3, 1024])
def test_block_averages(spark, monkeypatch, block):
    """Ragged layers, null weights and several keys, cut into blocks of any size, against numpy."""
    rng = random.Random(block)
    rows = [(rng.choice("xy"), i % 3, rng.choice([0, 1, 5, None]), [rng.random() for _ in range(rng.choice([0, 4, 7, 7]))]) for i in range(60)] + [("x", 0, 2, None)]
    got = weights.average(spark.createDataFrame(rows, "node string, layer int, n int, w array<double>").repartition(5), "node", block=block)
    want = {}
    for node, layer, n, w in rows:
        if n is not None and w is not None:
            total, count = want.setdefault((node, layer), (np.zeros(7), np.zeros(7)))
            total[: len(w)] += n * np.array(w)
            count[: len(w)] += n
    for r in got.collect():
        total, count = want.pop((r["node"], r["layer"]))
        for k, v in enumerate(r["w"]):
            assert v is None if count[k] == 0 else math.isclose(v, total[k] / count[k])
    assert not want


def test_integers_average_as_floats_and_nothing_as_nothing(spark):
    p = spark.createDataFrame([("a", 1, 0, [1, 2]), ("b", 1, 0, [2, 2])], "node string, n int, layer int, w array<int>")
    got = weights.average(p)
    assert got.schema["w"].dataType.elementType.simpleString() == "float" and got.first()["w"] == [1.5, 2.0]
    assert weights.average(p.limit(0)).count() == 0


def test_a_model_for_more_channels_and_other_classes(spark):
    kernel = np.arange(2 * 3 * 4, dtype=float)  # two filters, three channels, four places
    p = spark.createDataFrame([(0, kernel.tolist()), (1, [1.0, 2.0]), (2, [9.0] * 50)], "layer int, w array<double>")
    got = {r["layer"]: r["w"] for r in weights.build_model(p, first=0, known=3, channels=5, head=2, inputs=4, classes=2, area=4).collect()}
    cube = kernel.reshape(2, 3, 4)
    want = np.concatenate([cube, np.repeat(cube.mean(axis=1, keepdims=True), 2, axis=1)], axis=1)
    np.testing.assert_allclose(got[0], want.ravel())
    assert got[1] == [1.0, 2.0] and len(got[2]) == 8 and len(set(got[2])) == 8 and all(abs(x) <= 0.5 for x in got[2])


def samples(spark, n=60):
    rng = np.random.default_rng(1)
    rows = [("ab"[k % 2], ("train", "train", "val")[k % 3], int(k % 4), hashlib.md5(str(k).encode()).hexdigest(), rng.normal(size=4).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "node string, split string, label int, ord string, x array<double>")


def test_parts_of_a_node_train_apart_and_are_merged(spark):
    model, config = federate.Softmax(4, 4), federate.LocalConfig(epochs=2, batch=3, rate=0.1, part_rows=7)
    data = samples(spark)
    start = {"a": [np.full((4, 4), 0.1), np.zeros(4)], "b": [np.full((4, 4), -0.2), np.ones(4)]}
    models = spark.createDataFrame([(n, k, w.ravel().tolist()) for n, ws in start.items() for k, w in enumerate(ws)], "node string, layer int, w array<double>")
    got = federate.fit_locally(data.filter("split = 'train'"), models, model, config, 0.5, 3)
    parts = {}
    train = [r for r in data.collect() if r["split"] == "train"]
    for r in sorted(train, key=lambda r: r["ord"]):
        count = math.ceil(sum(x["node"] == r["node"] for x in train) / 7)
        parts.setdefault((r["node"], int(r["ord"][4:10], 16) % count), []).append(r)
    assert len(parts) > 4
    seen = set()
    for r in got.collect():
        rows = parts[r["node"], r["part"]]
        w, loss, n = federate.local_epochs(np.array([x["x"] for x in rows]), np.array([x["label"] for x in rows]), [x["ord"] for x in rows], start[r["node"]], model, config, 0.5, 3)
        assert r["n"] == len(rows) and r["seen"] == n == 2 * len(rows)
        np.testing.assert_allclose(r["w"], w[r["layer"]].ravel())
        assert math.isclose(r["loss"], loss)
        seen.add((r["node"], r["part"]))
    assert seen == set(parts)


def test_epochs_go_in_orders_of_their_own():
    """The first step of one epoch differs from that of the next, and moments start anew with each call."""
    orders = []

    class Spy(federate.Softmax):
        def gradients(self, w, x, y):
            orders.append(x[:, 0].tolist())
            return super().gradients(w, x, y)

    x = np.arange(12.0).reshape(12, 1)
    model, config = Spy(2, 1), federate.LocalConfig(epochs=2, batch=12)
    args = (x, np.arange(12) % 2, [str(k) for k in range(12)], model.initial(), model, config, 0.0)
    first = federate.local_epochs(*args, 1)[0]
    again = federate.local_epochs(*args, 1)[0]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1] and orders[:2] == orders[2:]
    assert all((a == b).all() for a, b in zip(first, again, strict=True))
    assert federate.local_epochs(*args, 2) and orders[4] != orders[0]


def test_rounds_stop_when_patience_ends(spark):
    out, models = federate.local_rounds(
        samples(spark), federate.strategy("fedavg", min_clients=2), written=stored, model=federate.Softmax(4, 4), rounds=9, patience=1,
        fit_config=lambda r: federate.LocalConfig(epochs=1, batch=4, rate=0.0), fit_metrics=lambda d: d.withColumn("double", F.col("n") * 2).select("node", "double"),
    )
    assert sorted({r["round"] for r in out.collect()}) == [1, 2]  # nothing moves, so the second is no better
    assert out.columns[-1] == "double" and models.count() == 4
    with pytest.raises(ValueError):
        federate.local_rounds(samples(spark), federate.strategy("fedavg"), written=stored)


def test_weight_versions(spark, tmp_path):
    path, model = str(tmp_path), lambda v: spark.createDataFrame([("a", 0, [v])], "node string, layer int, w array<double>")
    assert files.weight_versions(spark, path, "m") == []
    assert [files.save_weights(model(v), path, "m") for v in (1.0, 2.0)] == [1, 2]
    model(9.0).write.parquet(f"{path}/model=m/data/half-written")  # no commit, no version
    assert files.load_weights(spark, path, "m").first()["w"] == [2.0]
    assert files.load_weights(spark, path, "m", 1).first()["w"] == [1.0]
    seen = files.weight_versions
    try:  # another writer takes number 3 after it was looked up
        files.weight_versions = lambda *a: seen(*a)[:-1]
        assert files.save_weights(model(3.0), path, "m") == 3
    finally:
        files.weight_versions = seen
    assert files.weight_versions(spark, path, "m") == [1, 2, 3]


@pytest.mark.parametrize("size", [1, 5, 7, 64, 1 << 20])
def test_log_lines_are_numbered_wherever_a_file_is_cut(spark, tmp_path, size):
    texts = {"a.log": "one\n\n\ntwo\r\n  \nthree", "b.log": "", "c.log": "\n" * 9 + "last\n", "d.log": "x" * 50 + "\n" + "é\n" * 20}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = sorted((os.path.basename(r["path"]), r["line_num"], r["value"]) for r in files.numbered_logs(spark, str(tmp_path)).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    lines = {n: t.split("\n")[: None if not t.endswith("\n") and t else -1] for n, t in texts.items()}
    assert got == sorted((n, k, line.removesuffix("\r")) for n, ls in lines.items() for k, line in enumerate(ls))


def test_as_of_within_a_tolerance(spark):
    rng, base = random.Random(6), dt.datetime(2024, 1, 1)
    at = lambda: base + dt.timedelta(seconds=rng.randrange(5000))
    right = list({(k, t): (k, t, rng.random()) for k, t in ((rng.choice("abbbb"), at()) for _ in range(200))}.values())
    left = [(rng.choice("abbbbc"), at(), i) for i in range(150)] + [("b", right[0][1], 999), ("b", None, 1000)]
    got = frames.as_of_within(spark.createDataFrame(left, "k string, t timestamp, i int"), spark.createDataFrame([*right, ("b", None, 1.0)], "k string, t timestamp, v double"), "k", "t", "v", 60)
    want = {}
    for k, t, i in left:
        before = [(x[1], x[2]) for x in right if t is not None and x[0] == k and x[1] <= t and (t - x[1]).total_seconds() <= 60]
        want[i] = max(before)[1] if before else None
    assert {r["i"]: r["v"] for r in got.collect()} == want


def test_bootstrap(spark):
    rows = [(g, i, float(i % 7) if i % 11 else None) for g in "pq" for i in range(200)]
    got = analysis.bootstrap(spark.createDataFrame(rows, "g string, i int, v double").repartition(7), "i", "v", "g", replicates=12)
    cut = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    for r in got.collect():
        mine = [(i, v) for g, i, v in rows if g == r["g"] and v is not None]
        means = []
        for b in range(1, 13):
            draws = [int((int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:8], 16) / 2**32 >= cut).sum()) for i, _ in mine]
            means.append(sum(n * v for n, (_, v) in zip(draws, mine, strict=True)) / sum(draws))
        assert r["n"] == len(mine) and math.isclose(r["mean"], np.mean([v for _, v in mine]))
        np.testing.assert_allclose([r["low"], r["high"]], np.quantile(means, [0.05, 0.95]))


def test_core_rows(spark):
    lines = spark.createDataFrame([(1, "CPU [12%@1510, off,zz,0%@729] GR3D_FREQ 5%"), (2, "no cores"), (3, None), (4, "CPU [100%@1]")], "id long, value string")
    assert sorted(map(tuple, power.core_rows(spark, lines, "id").collect())) == [(1, 0, 12, 1510), (1, 1, 0, 0), (1, 3, 0, 729), (4, 0, 100, 1)]
    lines.createOrReplaceTempView("power_lines")
    assert spark.sql("SELECT count(*) FROM core_rows(TABLE(power_lines), 'id', 'value')").first()[0] == 4


def test_rounds_of_any_length_and_overlap(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    lines = power.parse(spark.createDataFrame([(t(h), "GPU 1000/1000") for h in range(0, 100, 3)], "ts timestamp, value string"))
    rounds = [(1, t(0), t(24)), (2, t(20), t(70)), (3, t(50), t(50)), (4, t(71), t(72)), (5, t(90), t(400))]
    got = power.by_round(lines, spark.createDataFrame(rounds, "round int, start timestamp, end timestamp"))
    want = {r: (n, (b - a).total_seconds()) for r, a, b in rounds if (n := sum(a <= t(h) < b for h in range(0, 100, 3)))}
    assert {r["round"]: (r["num_samples"], r["wall_s"]) for r in got.collect()} == want


# --- streams ----------------------------------------------------------------------------------------------------------


def test_state_needs_nothing_of_the_session(spark, sf):
    """A session with another provider, or none, runs stateful processors and has its own setting back."""
    own = spark.conf.get(streams.PROVIDER)
    try:
        for value in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
            spark.conf.unset(streams.PROVIDER) if value is None else spark.conf.set(streams.PROVIDER, value)
            before = spark.conf.get(streams.PROVIDER)
            assert streams.finished(streams.events(spark, sf), streams.running_means, shared_folder(spark), "update").count() == 5
            assert spark.conf.get(streams.PROVIDER) == before
    finally:
        spark.conf.set(streams.PROVIDER, own)


def test_a_batch_that_comes_again_changes_nothing(spark, sf, tmp_path):
    messages = stored(stand_ins.client_messages(spark, sf))
    spark.createDataFrame([], messages.schema).write.parquet(str(tmp_path / "in"))
    first = stand_ins.first_parameters(spark, sf).filter("node = 0").select("layer", "w")
    ran = []

    def add(updates, now):
        ran.append(updates.count())
        return now.select("layer", F.transform("w", lambda x: x + ran[-1]).alias("w"))

    source = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
    go = lambda: streams.versioned_rounds(source, first, add, str(tmp_path / "loop"))
    streams.deal_rounds(messages, str(tmp_path / "in"), [1, 2, 3], go)
    read = lambda: sorted((r["version"], r["layer"], r["w"][0]) for r in streams.versions(spark, str(tmp_path / "loop"), "layer int, w array<double>").collect())
    before = read()
    assert {v for v, _, _ in before} == {1, 2, 3} and len(ran) == 3
    last = max((tmp_path / "loop" / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    crc = last.with_name(f".{last.name}.crc")
    crc.unlink(missing_ok=True)
    go()
    assert len(ran) == 4 and ran[3] == ran[2] and read() == before


def test_frames_end_when_their_time_is_out(spark, tmp_path):
    """Parts out of order and over several batches; a late part does not bring a frame back."""
    t = lambda m: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m)
    batches = [
        [("view", t(5)), ("click", t(12))],
        [("error", t(9)), ("signup", t(3)), ("view", t(62)), ("click", t(63)), ("view", t(130)), ("error", t(200))],  # the first part was at 3, so 13 is the end
        [("error", t(65)), ("click", t(195)), ("purchase", t(203))],  # 65 is behind the watermark
    ]
    kind = "event_type string, ts timestamp"
    path = str(tmp_path / "in")
    spark.createDataFrame([], kind).write.parquet(path)
    stream = streams.frames_in_time(spark.readStream.schema(kind).parquet(path), late="10 minutes")
    out = []
    for rows in [*batches, [("view", t(100_000))]]:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
        streams.run(stream, lambda df, batch: out.extend(df.collect()), str(tmp_path / "state"))
    got = sorted(((r["frame"] // 60_000_000 - streams_minute(t(0))), r["status"], r["color_ts"] is not None, r["depth_ts"] is not None, r["ir_ts"] is not None) for r in out)
    assert got == [(0, "complete", True, True, True), (60, "dropped", True, True, False), (120, "dropped", True, False, False), (180, "complete", True, True, True)]


def streams_minute(at):
    return int(at.replace(tzinfo=dt.UTC).timestamp()) // 60


def test_open_windows_are_closed(spark, sf):
    """Every event is in a window of the result."""
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    out = streams.finished(streams.events(spark, sf), lambda e: streams.windowed(e, "1 hour"), shared_folder(spark))
    assert out.agg(F.sum("n")).first()[0] == n
