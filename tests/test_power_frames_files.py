import json

from pyspark.sql import functions as F

from quillmesh.operators import frames, power
from quillmesh.plans import catalogue
from quillmesh.sources import files

# Fixed value: a line as the devices write it.
SAMPLE = "RAM 2448/7620MB (lfb 4x4MB) SWAP 0/3810MB CPU [12%@1510,15%@1510,8%@1510,10%@1510,5%@1510,7%@1510] GR3D_FREQ 30% cpu@45.5C GPU 2500/15000 CPU 1800/10000 SOC 1200/8000 CV 0/0 VDDRQ 800/5000 SYS5V 3500/20000"


def parsed(spark, *lines):
    return power.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()


def test_sample_line(spark):
    (row,) = parsed(spark, SAMPLE)
    assert (row["power_total_mw"], row["power_total_w"], row["cpu_usage_percent"], row["cpu_num_active"], row["temp_cpu_c"], row["temp_tj_c"]) == (9800, 9.8, 9.5, 6, 45.5, None)


def test_off_cores_count_as_idle(spark):
    (row,) = parsed(spark, "CPU [12%@1510,off,0%@1510]")
    assert (row["cpu_usage_percent"], round(row["cpu_freq_mhz"], 3), row["cpu_num_active"], row["power_total_mw"]) == (4.0, 1006.667, 1, None)


def test_blank_and_unknown_lines_go(spark):
    assert [r["ram_used_mb"] for r in parsed(spark, "", "nonsense", "RAM 5/6MB")] == [5]


def test_single_sample(spark):
    (row,) = power.summary(power.parse(spark.createDataFrame([(SAMPLE,)], "value string"))).collect()
    assert (row["power_std_w"], row["duration_s"], row["num_samples"]) == (None, 0.1, 1)


def test_line_numbers_count_blank_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("RAM 1/2MB\n\nRAM 3/4MB")
    got = power.parse(power.numbered_lines(files.logs(spark, str(tmp_path)))).collect()
    assert sorted((r["line_num"], r["ram_used_mb"]) for r in got) == [(0, 1), (2, 3)]


def test_warm_up_and_as_of(spark):
    f = spark.range(200).withColumnRenamed("id", "frame")
    got = frames.after_warm_up(f, "frame", 30, 5).orderBy("frame").collect()
    assert [(r["frame"], r["frame_id"]) for r in got][0] == (30, "00000") and len(got) == 5
    left = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 2, 0.5), (1, 5, 0.7), (1, 8, 0.9)], "k int, t int, v double")
    assert {r["name"]: r["v"] for r in frames.as_of(left, right, "k", "t", "v").collect()} == {"x": 0.7, "y": None, "z": None}


def test_images_by_folder(spark, tmp_path):
    for p in ("Fire/x.JPG", "NoFire/y.png", "other/z.jpg", "Fire/notes.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"1")
    got = sorted((r["class"], r["label"]) for r in files.images(spark, str(tmp_path)).collect())
    assert got == [("Fire", 1), ("No_Fire", 0)]


def test_old_and_new_results(spark, tmp_path):
    body = {"strategy": "fedavg", "num_rounds": 1, "total_time_s": 2.5, "timestamp": "t", "losses_distributed": [{"round": 1, "loss": 0.5}], "metrics_distributed": {"accuracy": [{"round": 1, "value": 0.75}]}}
    for name, more in (("test_run", {}), ("3n_noniid_fedavg_seed123", {"min_clients": 3})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "results.json").write_text(json.dumps(body | more, indent=2))
    got = files.run_rounds(files.run_results(spark, str(tmp_path / "*" / "results.json"))).orderBy("run").collect()
    assert [(r["run"], r["seed"], r["dist"], r["loss"], r["accuracy"]) for r in got] == [("3n_noniid_fedavg_seed123", 123, "non_iid", 0.5, 0.75), ("test_run", 42, "iid", 0.5, 0.75)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).filter(F.col("node") == "all").count() == 1


def test_measured_rounds(spark, tmp_path):
    records = []
    with power.measured(records, 1, strategy="fedavg"):
        pass
    try:
        with power.measured(records, 2):
            raise ValueError("no log")
    except ValueError:
        pass
    assert [(r["round"], "error" in r, r["wall_s"] >= 0) for r in records] == [(1, False, True), (2, True, True)]
    power.save_rounds(spark, records, str(tmp_path / "rounds"))
    saved = spark.read.schema("round int, extra map<string, string>, error string").json(str(tmp_path / "rounds")).collect()
    assert sorted((r["round"], r["extra"], r["error"]) for r in saved) == [(1, {"strategy": "fedavg"}, None), (2, {}, "ValueError('no log')")]


def test_images_become_tensors(spark, tmp_path):
    import struct
    import zlib

    from quillmesh.operators import images

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\x00" + bytes([255, 0, 0] * 4) for _ in range(2))  # two rows of four red pixels
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"no image")
    (x,) = [r["x"] for r in images.tensors(images.decoded(spark, str(tmp_path)), size=3).collect()]
    want = [(v - m) / s for v, m, s in zip((1.0, 0.0, 0.0), images.MEAN, images.STD, strict=True)]
    assert len(x) == 27 and all(abs(x[9 * c + i] - want[c]) < 1e-5 for c in range(3) for i in range(9))
    once, again = (images.tensors(images.decoded(spark, str(tmp_path)), size=3, steps=images.TRAINING).first()["x"] for _ in range(2))
    assert once == again


def test_configured_pairs(spark):
    from quillmesh.operators import federate

    tests = spark.createDataFrame([("a",), ("b",)], "node string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "zzz"), ("fl_all", None)], "train string, test string")
    assert sorted(map(tuple, federate.train_test_pairs(tests, pairs).collect())) == [("a", "b"), ("fl_all", "a"), ("fl_all", "b")]


def test_line_numbers_gather_no_log_in_one_row(spark, sf):
    lines = spark.createDataFrame([("a" if i % 3 else "b", i * 7, f"line {i}") for i in range(-500, 1000)] + [("a", None, "first")], "log string, event_id long, value string")
    got = {(r["log"], r["value"]): r["line_num"] for r in power.line_numbers(lines, "log", "event_id", bits=6).collect()}
    want = {("a", "first"): 0}
    for log in "ab":
        want |= {(log, f"line {i}"): n + (log == "a") for n, i in enumerate(i for i in range(-500, 1000) if ("a" if i % 3 else "b") == log)}
    assert got == want
    plan = catalogue.queries()["q31_power_line_numbers"](spark, sf)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_rotation_and_chain_depend_on_seed_and_path():
    import numpy as np

    from quillmesh.operators import images

    a = np.random.default_rng(1).random((9, 9, 3))
    same = [images.rotated(a, np.random.default_rng(5)) for _ in range(2)]
    assert (same[0] == same[1]).all() and same[0].shape == a.shape
    assert np.allclose(images.rotated(a, np.random.default_rng(5), 0.0), a)
    assert images.jittered(a, np.random.default_rng(2)).max() <= 1.0
    assert {float(images.flipped(a, np.random.default_rng(k))[0, 0, 0]) for k in range(20)} == {float(a[0, 0, 0]), float(a[0, -1, 0])}


def test_written_names_are_unique_and_splits_read_back(spark, tmp_path):
    from quillmesh.operators import partition

    rows = [("iid", "node_a", "train", "Fire", f"/{d}/{n}.jpg") for d in "xy" for n in "pq"] + [("iid", "node_a", "test", "Fire", "/x/p.jpg"), ("iid", "node_b", "train", "No_Fire", "/x/p.jpg")]
    splits = spark.createDataFrame(rows, "dist string, node string, split string, class string, path string")
    partition.write_splits(splits, str(tmp_path / "s"))
    partition.write_splits(splits, str(tmp_path / "s"))
    got = files.split_members(spark, str(tmp_path / "s"), "iid", "node_a", "train").collect()
    assert sorted(r["path"] for r in got) == ["/y/p.jpg", "/y/q.jpg"]
    assert files.split_members(spark, str(tmp_path / "s"), "iid", "node_b", "train").count() == 1


def test_settings(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("rounds: 3\nstrategies:\n  - fedavg\n  - name: fedprox\n    mu: 0.1\n")
    (tmp_path / "b.yaml").write_text("")
    got = {r["key"]: r["value"] for r in files.settings(spark, str(tmp_path)).collect()}
    assert got == {"rounds": "3", "strategies.0": '"fedavg"', "strategies.1.name": '"fedprox"', "strategies.1.mu": "0.1"}


def test_named_weights(spark, tmp_path):
    params = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0])], "node string, layer int, w array<double>")
    for p in (params.limit(1), params):
        files.save_weights(p, str(tmp_path), "final")
    assert sorted(map(tuple, files.load_weights(spark, str(tmp_path), "final").collect())) == [("a", 0, [1.0, 2.0]), ("a", 1, [3.0])]


def test_baseline_results(spark, tmp_path):
    from quillmesh.sources import export

    finals = spark.createDataFrame([("central", 0, 0.12345678, 1.0), ("central", 1, 0.5, 2.0)], "run string, seed int, accuracy double, minutes double")
    files.write_summary(export.baseline_document(finals).withColumnRenamed("mean_test_accuracy", "final_test_accuracy"), str(tmp_path / "b"))
    (row,) = files.baseline_results(spark, str(tmp_path / "b")).collect()
    assert (row["experiment"], row["total_time_s"], row["final_test_accuracy"], row["epochs"]) == ("central", 180.0, 0.311728, None)
    files.write_summary(power.summary(power.parse(spark.createDataFrame([(SAMPLE,)], "value string"))), str(tmp_path / "p"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).first()["num_samples"] == "1"


def test_progress_and_rounds_by_batch(spark, tmp_path):
    from quillmesh.streaming import streams

    told, steps = [], []
    listener = streams.Progress(every=50, tell=told.append)
    spark.streams.addListener(listener)
    spark.range(120).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    streams.rounds_by_batch(stream, lambda df, batch: steps.append((batch, df.count())), str(tmp_path / "cp"))
    for _ in range(50):
        if told:
            break
        import time

        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert steps == [(0, 120)] and told == [120] and listener.seen[0][1:] == (0, 120)


def test_power_lines_in_one_pass(spark):
    """The first of repeated fields counts, odd units and cores are no fields, and the plan evaluates each pattern once."""
    rows = parsed(spark, "GPU 5/6 GPU 7/8 XGPU 9/9", "RAM 1/2GB SWAP 3/4MB", "CPU [12%@1510,bad,off] cpu@1.5C", "cpu@1.2.3C", "tj@3C", "GPU 99999999999/1")
    assert [(r["power_gpu_mw"], r["power_gpu_avg_mw"], r["ram_used_mb"], r["swap_used_mb"], r["cpu_num_active"], r["temp_cpu_c"], r["temp_tj_c"]) for r in rows] == [
        (5, 6, None, None, None, None, None), (None, None, None, 3, None, None, None), (None, None, None, None, 1, 1.5, None), (None,) * 7, (None, None, None, None, None, None, 3.0), (None, 1, None, None, None, None, None)
    ]
    plan = power.summary(power.parse(spark.createDataFrame([(SAMPLE,)], "value string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2
