"""Registry of the engine's own queries; their oracle SQL is in ``oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as w

from quillmesh.functions import expr
from quillmesh.functions.expr import half_even
from quillmesh.operators import analysis, federate, frames, images, metrics, partition, power, weights
from quillmesh.plans import oracle
from quillmesh.plans import stand_ins as data
from quillmesh.sources import export, files
from quillmesh.sources.shared import shared_folder, stored
from quillmesh.sources.tables import table
from quillmesh.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def r6(c) -> F.Column:
    return half_even(c, 6)


# --- inventory and partitioning -------------------------------------------------------------------------------------


@query
def q01_image_inventory(s, d):
    return partition.inventory(data.toxic_samples(s, d))


@query
def q02_iid_partition(s, d):
    return partition.iid(data.samples(s, d))


@query
def q03_split_stats_iid(s, d):
    return partition.statistics(partition.split(partition.iid(data.samples(s, d))).withColumn("dist", F.lit("iid")))


@query
def q04_noniid_partition_2(s, d):
    return partition.label_skew(data.samples(s, d), 2)


@query
def q05_noniid_partition_3(s, d):
    return partition.label_skew(data.samples(s, d), 3)


@query
def q06_noniid_toxic_clamped(s, d):
    return partition.label_skew(data.toxic_samples(s, d), 3).groupBy("node", "class").agg(F.count("*").alias("n"))


@query
def q07_split_rollup(s, d):
    iid = partition.split(partition.iid(data.samples(s, d))).withColumn("dist", F.lit("iid"))
    skew = partition.split(partition.label_skew(data.samples(s, d), 3)).withColumn("dist", F.lit("non_iid"))
    return iid.unionByName(skew).rollup("dist", "node", "split").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query
def q08_split_leak_check(s, d):
    splits = partition.split(partition.iid(data.samples(s, d)))
    ids = lambda name: splits.filter(F.col("split") == name).select("id")
    both = ids("train").intersect(ids("test")).agg(F.count("*").alias("n_leaked"))
    sizes = splits.agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"))
    return both.crossJoin(sizes)  # one row each


# --- metrics ----------------------------------------------------------------------------------------------------------


@query
def q09_weighted_accuracy(s, d):
    m = metrics.aggregate_round(data.client_metrics(s, d), "round")
    return m.select("round", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("loss")).alias("loss"), "num_examples")


@query
def q10_positional_rounds(s, d):
    m = data.client_metrics(s, d)
    m = metrics.aggregate_round(m, "round").join(metrics.ready(m, 3), "round")
    return m.select("round", F.row_number().over(w.Window.orderBy("round")).cast("long").alias("position"), r6(F.col("loss")).alias("loss"))


@query
def q11_epoch_loss_partial(s, d):
    batches = data.client_metrics(s, d).groupBy("node", "round").agg(F.sum(F.col("loss") * F.col("num_examples")).alias("part"), F.sum("num_examples").alias("n"))
    return batches.groupBy("node").agg(r6(F.sum("part") / F.greatest(F.sum("n"), F.lit(1.0))).alias("epoch_loss"))


@query
def q12_eval_argmax(s, d):
    e = table(s, d, "embeddings").select("label", (expr.argmax(F.col("embedding")) % 10).alias("pred"))
    return metrics.evaluation(e).select("num_examples", "correct", r6(F.col("accuracy")).alias("accuracy"))


@query
def q12b_cross_entropy(s, d):
    e = table(s, d, "embeddings").select(F.col("label").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    return e.groupBy("y").agg(r6(F.avg(expr.cross_entropy(F.col("z"), F.col("y")))).alias("loss"), F.count("*").alias("n"))


@query
def q13_node_mean_unweighted(s, d):
    per_node = data.client_metrics(s, d).groupBy("node").agg(F.avg("accuracy").alias("a"))
    return per_node.agg(r6(F.avg("a")).alias("mean_accuracy"), F.count("*").alias("n_nodes"))


# --- parameters -------------------------------------------------------------------------------------------------------


@query
def q14_fedavg_arrays(s, d):
    return weights.fedavg(data.params(s, d)).select("layer", "pos", r6(F.col("value")).alias("value"))


@query
def q15_fedbn_arrays(s, d):
    return weights.fedbn(data.params(s, d), data.bn_layers(s, d)).select("layer", "pos", r6(F.col("value")).alias("value"))


@query
def q16_prox_term(s, d):
    p = data.params(s, d)
    local = p.select("node", "layer", F.transform("w", lambda x: x.cast("double")).alias("w"))
    return weights.proximal(local, weights.assemble(weights.fedavg(p)), 0.01).select("node", r6(F.col("prox")).alias("prox"))


@query
def q17_bn_semi(s, d):
    return data.params(s, d).join(F.broadcast(data.bn_layers(s, d)), "layer", "left_semi").groupBy("layer").agg(F.count("*").alias("n"))


@query
def q17b_bn_anti(s, d):
    return data.params(s, d).join(F.broadcast(data.bn_layers(s, d)), "layer", "left_anti").groupBy("layer").agg(F.count("*").alias("n"))


@query
def q18_load_keep_local(s, d):
    p = data.params(s, d).withColumn("w", F.transform("w", lambda x: x.cast("double")))
    got = weights.load(p, weights.assemble(weights.fedavg(p)), data.bn_layers(s, d))
    return got.select("node", "layer", r6(F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query
def q19_param_size(s, d):
    return weights.footprint(data.params(s, d))


@query
def q20_channel_widen(s, d):
    wider = expr.widen_channels(F.transform("embedding", lambda x: x.cast("double")), 64, 66)
    return table(s, d, "embeddings").select("vec_id", F.posexplode(wider).alias("channel", "v")).select("vec_id", "channel", r6(F.col("v")).alias("value"))


# --- training ---------------------------------------------------------------------------------------------------------


def _local(s, d, placed):
    return federate.centroids(placed.filter("split = 'train'"), "node")


@query
def q21_local_centroids(s, d):
    return _local(s, d, data.placed(s, d)).select("node", "label", "pos", r6(F.col("value")).alias("value"), "n")


@query
def q22_fedavg_centroid_round(s, d):
    placed = data.placed(s, d)
    model = federate.as_vectors(federate.average_centroids(_local(s, d, placed)))
    scored = federate.predict(placed.filter("split = 'val'"), model)
    out = scored.rollup("node").agg(F.count("*").alias("num_examples"), F.count_if(F.col("pred") == F.col("label")).alias("correct"))
    return out.select(F.coalesce("node", F.lit("all")).alias("node"), "num_examples", "correct", r6(F.col("correct") / F.col("num_examples")).alias("accuracy"))


@query
def q23_fedprox_centroid(s, d):
    local = _local(s, d, data.placed(s, d))
    shared = federate.average_centroids(local)
    out = None
    for mu in (0.0, 0.01, 0.1):
        part = federate.proximal_centroids(local, shared, mu).groupBy("node").agg(F.sum(F.col("value") * F.col("value")).alias("q")).select(F.lit(mu).alias("mu"), "node", r6(F.col("q")).alias("norm2"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def q24_centralized_centroid(s, d):
    placed = data.placed(s, d)
    model = federate.as_vectors(federate.centroids(placed.filter("split = 'train'")))
    scored = federate.predict(placed.filter("split = 'test'"), model)
    out = scored.rollup("node").agg(F.count("*").alias("num_examples"), F.count_if(F.col("pred") == F.col("label")).alias("correct"))
    return out.select(F.coalesce("node", F.lit("all")).alias("node"), "num_examples", "correct")


@query
def q25_cross_eval(s, d):
    placed = data.placed(s, d)
    models = federate.as_vectors(_local(s, d, placed), "node").withColumnRenamed("node", "train_node")
    scored = federate.predict(placed.filter("split = 'test'"), models, F.col("train_node") != F.col("node"))
    return scored.groupBy("train_node", F.col("node").alias("test_node")).agg(F.count("*").alias("num_examples"), F.count_if(F.col("pred") == F.col("label")).alias("correct"))


# --- power logs -------------------------------------------------------------------------------------------------------


@query
def q26_power_parse(s, d):
    p = power.parse(data.log_lines(s, d))
    not_compared = {"swap_total_mb", "power_cpu_avg_mw", "power_soc_avg_mw", "power_cv_avg_mw", "power_total_mw", "power_total_w"}
    names = [c for c in p.columns if c.startswith(("ram", "swap", "gpu", "power", "temp")) and c not in not_compared and "vddrq" not in c and "sys5v" not in c]
    return p.select("event_id", *names)


@query
def q27_power_cores(s, d):
    p = power.parse(data.log_lines(s, d))
    return p.select("event_id", r6(F.col("cpu_usage_percent")).alias("usage"), r6(F.col("cpu_freq_mhz")).alias("freq"), F.col("cpu_num_active").cast("long").alias("active"))


@query
def q28_power_total(s, d):
    return power.parse(data.log_lines(s, d)).select("event_id", F.col("power_total_mw").cast("long").alias("total_mw"), "power_total_w")


@query
def q29_power_summary(s, d):
    t = power.summary(power.parse(data.log_lines(s, d)))
    energy = ("power_max_w", "power_min_w", "power_std_w", "gpu_power_max_w", "energy_total_wh")
    return t.select("num_samples", "duration_s", *energy, "ram_peak_mb", "temp_cpu_c_max", r6(F.col("power_avg_w")).alias("power_avg_w"))


@query
def q30_power_by_round(s, d):
    lines = power.parse(data.log_lines(s, d))
    day = F.date_trunc("day", "ts")
    rounds = table(s, d, "events").select(day.alias("start")).distinct().select(F.dayofyear("start").alias("round"), "start", (F.col("start") + F.expr("interval 1 day")).alias("end"))
    return power.by_round(lines, rounds).select("round", "num_samples", "duration_s", "wall_s", "power_max_w", "power_avg_w")


@query
def q31_power_line_numbers(s, d):
    lines = data.log_lines(s, d).withColumn("log", F.date_format("ts", "yyyy-MM-dd"))
    return power.line_numbers(lines, "log", "event_id").select("log", "line_num", F.md5("value").alias("line_md5"))


# --- frames -----------------------------------------------------------------------------------------------------------


@query
def q32_frame_complete(s, d):
    return frames.assemble(data.frame_events(s, d), "frame").select("frame", "color_ts", "depth_ts", "ir_ts", "n_events")


@query
def q33_frame_warmup(s, d):
    return frames.after_warm_up(frames.assemble(data.frame_events(s, d), "frame"), "frame").select("frame", "frame_id")


@query
def q34_depth_stats(s, d):
    e = table(s, d, "events").select("event_type", "ts", (F.col("value") - 10).alias("depth"))
    low, high = frames.depth_range(F.col("depth"))
    span = (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 1e6
    return e.groupBy("event_type").agg(r6(low).alias("depth_min"), r6(high).alias("depth_max"), r6(F.try_divide(F.count("*"), span)).alias("fps"))


@query
def q35_frame_metadata_json(s, d):
    e = table(s, d, "events").withColumn("j", F.from_json("props", "k int"))
    return e.select("event_id", F.lpad(F.col("event_id").cast("string"), 8, "0").alias("frame_id"), F.col("j.k").alias("k"), F.to_json(F.struct(F.col("j.k").alias("fx"), (F.col("j.k") * 2).alias("fy"))).alias("intrinsics"))


# --- analysis ---------------------------------------------------------------------------------------------------------


@query
def q36_experiment_matrix(s, d):
    o = table(s, d, "orders")
    strategies, seeds = o.select(F.col("o_orderpriority").alias("strategy")).distinct(), o.select((F.col("o_custkey") % 3).alias("seed")).distinct()
    dists = o.select(F.col("o_orderstatus").alias("dist")).distinct()
    done = o.filter("o_totalprice > 499000").select(F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("dist"), (F.col("o_custkey") % 3).alias("seed")).distinct()
    return analysis.open_runs(strategies, dists, seeds, done)


@query
def q37_fl_round_equivalents(s, d):
    m = data.client_metrics(s, d).groupBy("node", (F.col("round") * 5).alias("epoch")).agg(F.avg("loss").alias("loss"))
    at = lambda e: r6(F.max(F.when(F.col("epoch") == e, F.col("loss"))))
    return m.groupBy("node").agg(at(5).alias("epoch_5"), at(10).alias("epoch_10"), at(15).alias("epoch_15"), at(50).alias("epoch_50"))


@query
def q38_convergence_table(s, d):
    per = data.runs(s, d).groupBy("run", "round").agg(F.avg("accuracy").alias("accuracy"))
    t = analysis.convergence(per)
    return t.select("run", *[r6(F.col(c)).alias(c) for c in ("r1", "r2", "r3", "first_acc", "last_acc", "gain")])


def _finals(s, d):
    return data.runs(s, d).filter("round = 3").groupBy("run").agg(F.avg("accuracy").alias("accuracy"), F.avg("minutes").alias("minutes"))


@query
def q39_findings(s, d):
    return analysis.differences(_finals(s, d)).select("run_a", "run_b", r6(F.col("diff_pp")).alias("diff_pp"), r6(F.col("diff_minutes")).alias("diff_minutes"))


@query
def q40_mean_std_over_seeds(s, d):
    t = analysis.over_seeds(data.runs(s, d).filter("round = 3"))
    return t.select("run", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "ci95")])


def _rounds(s, d, name):
    plan = federate.strategy(name)
    out = federate.run_rounds(data.placed(s, d), plan, written=stored)
    return out.select("round", "node", "num_examples", *[r6(F.col(c)).alias(c) for c in ("train_loss", "loss", "accuracy")])


@query
def q41_softmax_fedavg(s, d):
    return _rounds(s, d, "fedavg")


@query
def q42_softmax_fedprox(s, d):
    return _rounds(s, d, "fedprox_0.1")


@query
def q42b_softmax_fedbn(s, d):
    return _rounds(s, d, "fedbn")


@query
def q41b_softmax_centralized(s, d):
    out = federate.run_rounds(federate.centralized(data.placed(s, d)), federate.strategy("fedavg", min_clients=1), written=stored)
    return out.select("round", "node", "num_examples", *[r6(F.col(c)).alias(c) for c in ("train_loss", "loss", "accuracy")])


@query
def q41c_softmax_local_only(s, d):
    return _rounds(s, d, "local")


# --- streams ----------------------------------------------------------------------------------------------------------


def _micros(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def _stream(s, d, build, mode="append"):
    return streams.finished(streams.events(s, d), build, shared_folder(s), mode)


@query
def q43_stream_tumbling(s, d):
    out = _stream(s, d, lambda e: streams.windowed(e, "1 hour"))
    return _micros(out, "start").select("start", "event_type", "n", r6(F.col("total")).alias("total"))


@query
def q44_stream_sliding(s, d):
    out = _stream(s, d, lambda e: streams.windowed(e, "2 hours", "1 hour"))
    return _micros(out, "start").select("start", "event_type", "n", r6(F.col("total")).alias("total"))


@query
def q45_stream_session(s, d):
    return _micros(_stream(s, d, streams.sessions), "start", "stop").select("start", "stop", "user_id", "n")


@query
def q46_stream_stateful(s, d):
    out = _stream(s, d, streams.running_means, "update")
    last = out.groupBy("event_type").agg(F.max_by(F.struct("n", "mean"), "n").alias("x"))
    return last.select("event_type", "x.n", r6(F.col("x.mean")).alias("mean"))


@query
def q46b_stream_frames(s, d):
    return _micros(_stream(s, d, streams.frame_sets), "start").select("start", "n_events")


@query
def q63_stream_client_state(s, d):
    """Parameters of each node after three rounds, each a run over the checkpoint of the one before."""
    base, messages = f"{shared_folder(s)}/clients-{uuid.uuid4().hex}", stored(data.client_messages(s, d))
    s.createDataFrame([], messages.schema).write.parquet(f"{base}/messages")
    states = streams.client_parameters(s.readStream.schema(messages.schema).parquet(f"{base}/messages"), data.first_parameters(s, d))
    store = lambda df, batch: df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
    streams.deal_rounds(messages, f"{base}/messages", [1, 2, 3], lambda: streams.run(states, store, f"{base}/state", "update"))
    last = s.read.schema(states.schema).parquet(f"{base}/out").groupBy("node", "layer").agg(F.max_by("w", "round").alias("w"))
    return last.select("node", "layer", F.posexplode("w").alias("pos", "v")).select("node", "layer", "pos", r6(F.col("v")).alias("value"))


@query
def q64_stream_rounds(s, d):
    """Three rounds of averaging, one for each micro-batch: all versions of the weights."""
    base, messages = f"{shared_folder(s)}/rounds-{uuid.uuid4().hex}", stored(data.client_messages(s, d))
    s.createDataFrame([], messages.schema).write.parquet(f"{base}/updates")
    first = data.first_parameters(s, d).filter("node = 0").select("layer", "w")

    def add(updates: DataFrame, now: DataFrame) -> DataFrame:
        moved = weights.average(updates.select("layer", "n", F.col("moved").alias("w"))).withColumnRenamed("w", "moved")
        return now.join(moved, "layer", "left").select("layer", F.when(F.col("moved").isNull(), F.col("w")).otherwise(F.zip_with("w", "moved", lambda a, b: a + b)).alias("w"))

    updates = s.readStream.schema(messages.schema).parquet(f"{base}/updates")
    streams.deal_rounds(messages, f"{base}/updates", [1, 2, 3], lambda: streams.versioned_rounds(updates, first, add, base))
    flat = streams.versions(s, base, "layer int, w array<double>").select("version", "layer", F.posexplode("w").alias("pos", "v"))
    return flat.select("version", "layer", "pos", r6(F.col("v")).alias("value"))


@query
def q65_stream_frame_timeout(s, d):
    out = _stream(s, d, streams.frames_in_time)
    return out.select("status", *[streams.as_micros(F.col(c)).alias(c) for c in ("frame", "color_ts", "depth_ts", "ir_ts")])


@query
def q66_stream_power_by_round(s, d):
    """Samples and rounds are both streams; the summary of what they join to."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    rounds = table(s, d, "events").select(day.alias("start")).distinct().select(F.dayofyear("start").alias("round"), "start", (F.col("start") + F.expr("interval 1 day")).alias("end"))
    path = f"{shared_folder(s)}/rounds-{uuid.uuid4().hex}"
    rounds.write.parquet(path)
    begun = s.readStream.schema(rounds.schema).parquet(path)
    met = _stream(s, d, lambda e: streams.measured_samples(power.parse(data.as_log_lines(e)), begun).select("round", "start", "end", "power_total_w", *power.SUMMARISED))
    wall = met.groupBy("round").agg(F.max((F.unix_micros("end") - F.unix_micros("start")) / 1e6).alias("wall_s"))
    return power.summary(met, "round").join(wall, "round").select("round", "num_samples", "duration_s", "wall_s", "power_max_w", "power_avg_w")


# --- local training, files, alignment in time ---------------------------------------------------------------------------


@query
def q67_local_epochs(s, d):
    """Two rounds of local epochs with Adam and a proximal term; parts of a node train where their samples are."""
    config = federate.LocalConfig(epochs=2, batch=64, rate=0.05)
    out, _ = federate.local_rounds(data.placed(s, d), federate.strategy("fedprox_0.1"), written=stored, rounds=2, fit_config=lambda r: config)
    return out.select("round", "node", "num_examples", *[r6(F.col(c)).alias(c) for c in ("train_loss", "loss", "accuracy")])


@query
def q68_log_numbers(s, d):
    """The power log as text files of a day each, with a blank line after every seventh event's, read back in splits."""
    lines = data.log_lines(s, d).withColumn("log", F.date_format("ts", "yyyy-MM-dd"))
    path = f"{shared_folder(s)}/logs-{uuid.uuid4().hex}"
    texts = lines.select("log", F.when(F.col("event_id") % 7 == 0, F.concat("value", F.lit("\n"))).otherwise(F.col("value")).alias("value"), "event_id")
    texts.repartition("log").sortWithinPartitions("log", "event_id").select("log", "value").write.partitionBy("log").text(path)
    found = files.numbered_logs(s, path)
    return found.select(F.regexp_extract("path", r"log=([0-9-]+)", 1).alias("log"), "line_num", F.md5("value").alias("line_md5"))


@query
def q69_core_rows(s, d):
    return power.core_rows(s, data.log_lines(s, d), "event_id")


@query
def q70_as_of_within(s, d):
    e = table(s, d, "events")
    left = e.filter("event_type IN ('purchase', 'signup', 'error')").select("user_id", "ts", "event_id")
    right = e.filter("event_type IN ('view', 'click')").groupBy("user_id", "ts").agg(F.max("value").alias("seen"))
    return frames.as_of_within(left, right, "user_id", "ts", "seen", 6 * 3600).select("event_id", "user_id", "seen")


@query
def q71_weight_versions(s, d):
    """Two versions of a model: the average of all layers, then of all but the normalisation layers."""
    path, p = f"{shared_folder(s)}/models-{uuid.uuid4().hex}", data.params(s, d)
    named = lambda w: w.withColumn("node", F.lit("server"))
    numbers = [files.save_weights(named(w), path, "shared") for w in (weights.average(p), weights.average_but(p, data.bn_layers(s, d)))]
    out = [files.load_weights(s, path, "shared", n).select(F.lit(n).alias("version"), "layer", F.posexplode("w").alias("pos", "v")) for n in numbers]
    return out[0].unionByName(out[1]).select("version", "layer", "pos", r6(F.col("v")).alias("value"))


@query
def q73_model_factory(s, d):
    """Every client's vector as a pretrained model: its first layer (4 filters of 2 channels) for 3 channels, its last for 2 classes."""
    built = weights.build_model(data.params(s, d), first=0, known=2, channels=3, head=7, inputs=8, classes=2)
    return built.groupBy("layer").agg(F.sum(F.size("w")).alias("n_params"), r6(F.sum(F.aggregate("w", F.lit(0.0), lambda a, x: a + x))).alias("total"))


@query
def q72_bootstrap(s, d):
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("run"), "o_orderkey", (F.col("o_totalprice") / 1000).alias("v"))
    t = analysis.bootstrap(o, "o_orderkey", "v", "run")
    return t.select("run", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "low", "high")])


# --- extensions: planned by the recorded experiments, or standard coverage ---------------------------------------------


@query
def q47_friedman_ranks(s, d):
    return analysis.friedman(data.runs(s, d).filter("round = 3")).select("run", r6(F.col("mean_rank")).alias("mean_rank"), "statistic")


@query
def q48_cohens_d(s, d):
    return analysis.cohens_d(data.runs(s, d).filter("round = 3")).select("run_a", "run_b", r6(F.col("d")).alias("d"))


@query
def q49_transfer_time(s, d):
    rate, loss = F.col("l_quantity") * 1e6, F.col("l_discount")
    t = table(s, d, "lineitem").withColumn("seconds", F.try_divide(F.col("l_extendedprice") * 8, rate * (1 - loss)))
    return t.groupBy("l_returnflag").agg(r6(F.avg("seconds")).alias("mean_seconds"), r6(F.max("seconds")).alias("max_seconds"))


@query
def q50_modality_channels(s, d):
    m = F.create_map(F.lit("rgb"), F.slice("embedding", 1, 48), F.lit("depth"), F.slice("embedding", 49, 8), F.lit("ir"), F.slice("embedding", 57, 8))
    e = table(s, d, "embeddings").select(F.explode(m).alias("modality", "v")).select("modality", F.size("v").alias("channels"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("t"))
    return e.groupBy("modality").agg(F.sum("channels").alias("channels"), r6(F.avg("t")).alias("mean_total"))


@query
def q51_as_of_join(s, d):
    e = table(s, d, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("seen"))
    return frames.as_of(left, right, "user_id", "ts", "seen").select("event_id", "user_id", "seen")


@query
def q52_cube_and_sets(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query
def q53_round_change(s, d):
    m = metrics.aggregate_round(data.client_metrics(s, d), "node", "round")
    by = w.Window.partitionBy("node").orderBy("round")
    return m.select("node", "round", r6(F.col("loss") - F.lag("loss").over(by)).alias("change"), r6(F.avg("accuracy").over(by.rowsBetween(-2, 0))).alias("moving"))


@query
def q54_full_outer_nodes(s, d):
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("clients"))
    p = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("servers"))
    return c.join(p, "nation", "full_outer").select("nation", "clients", "servers")


@query
def q55_normalised_channels(s, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    e = table(s, d, "embeddings").select("vec_id", F.aggregate(images.normalised(x, F.col("label") % 3), F.lit(0.0), lambda a, v: a + v).alias("t"))
    return e.select("vec_id", r6(F.col("t")).alias("total"))


@query
def q56_results_document(s, d):
    per = data.runs(s, d).groupBy("run", "round").agg(r6(F.avg("accuracy")).alias("accuracy"), r6(F.avg("minutes")).alias("loss"))
    doc = export.run_document(per)
    return doc.select("run", F.explode("losses_distributed").alias("l")).select("run", F.col("l.round").cast("long").alias("position"), F.col("l.loss").alias("loss"))


@query
def q57_nested_statistics(s, d):
    doc = export.nested_statistics(partition.statistics(partition.split(partition.iid(data.samples(s, d))).withColumn("dist", F.lit("iid"))))
    nodes = doc.select(F.explode(F.try_element_at("split_stats", F.lit("iid"))).alias("node", "m"))
    return nodes.select("node", F.explode("m").alias("split", "v")).select("node", "split", "v.total")


@query
def q58_time_and_accuracy(s, d):
    return analysis.final(data.runs(s, d), "run", "seed").select("run", "seed", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("minutes")).alias("minutes"))


@query
def q59_nodes_side_by_side(s, d):
    t = analysis.side_by_side(analysis.final(data.runs(s, d), "run", "seed"), "run", "seed", [0, 1, 2])
    return t.select("run", *[r6(F.col(c)).alias(c) for c in ("seed_0", "seed_1", "seed_2")])


#: Name, run, round, other run, its round, measure: what separates the runs at first, what is left of it at last, what it takes.
NAMED_FINDINGS = [
    ("first_round_gap", "1-URGENT", 1, "2-HIGH", 1, "accuracy"), ("first_round_gain", "3-MEDIUM", 1, "2-HIGH", 1, "accuracy"), ("scale_even", "1-URGENT", 1, "5-LOW", 1, "accuracy"),
    ("scale_skewed", "2-HIGH", 1, "4-NOT SPECIFIED", 1, "accuracy"), ("last_round_gap", "1-URGENT", 3, "2-HIGH", 3, "accuracy"), ("recovered", "2-HIGH", 3, "2-HIGH", 1, "accuracy"), ("overhead", "3-MEDIUM", 3, "2-HIGH", 3, "minutes"),
]


@query
def q60_named_findings(s, d):
    per = data.runs(s, d).groupBy("run", "round").agg(F.avg("accuracy").alias("accuracy"), F.avg("minutes").alias("minutes"))
    return analysis.findings(per, NAMED_FINDINGS).select("finding", r6(F.col("value")).alias("value"))


@query
def q61_unique_names(s, d):
    p = table(s, d, "pages").select(F.expr("parse_url(url, 'HOST')").alias("host"), "url").filter("host IS NOT NULL")
    return partition.by_base_name(p, "url", "host").select("host", "base_name", "url")


@query
def q62_baseline_document(s, d):
    doc = export.baseline_document(analysis.final(data.runs(s, d), "run", "seed"))
    nodes = doc.select("experiment", "total_time_s", "mean_test_accuracy", F.explode("nodes").alias("node", "result"))
    return nodes.select("experiment", "total_time_s", "mean_test_accuracy", "node", "result.final_test_accuracy", F.col("result.total_time_s").alias("node_time_s"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in REGISTRY}
