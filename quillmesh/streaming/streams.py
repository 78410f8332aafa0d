"""Streaming forms: windows and joins over event time, state for each key, timers, rounds by micro-batch; run to the end of what is there."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import PurePosixPath

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import IntegerType, StructField, StructType

from quillmesh.plans.stand_ins import stream_kind

# Workers that start a processor need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State beyond the heap, and what stateful processors ask for, whatever the session says; it has its own setting back afterwards."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, old)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; its ts has no zone, and watermarks ask for one."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    name = PurePosixPath(path).name
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> list[dict]:
    """Runs ``step`` for each micro-batch of what is available now, and returns the progress of the batches.

    ``step`` must be idempotent: after a failure the last batch comes again with the same number.
    """
    with rocksdb(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]


def finished(source: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, mode: str = "append", ts: str = "ts", late_rows_after: str = "1000 days") -> DataFrame:
    """Runs ``build`` over all that ``source`` has now, closes what is still open, and returns what the batches wrote, with their number.

    In append mode a window, session or timer ends when the watermark passes it. After the data a marker row, null but for a
    time far ahead, comes through a source of its own: the watermark passes everything that is open, so nothing is left
    behind in the state but the marker. Each micro-batch replaces its own folder, so a repeated batch leaves no double rows.
    """
    spark, base = source.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    spark.createDataFrame([], source.schema).write.parquet(f"{base}/end")
    stream = build(source.unionByName(spark.readStream.schema(source.schema).parquet(f"{base}/end")))
    kind, done = stream.schema, []

    def store(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
        done.append(batch)

    progress = run(stream, store, f"{base}/state", mode)
    seen = max((p["eventTime"]["max"] for p in progress if "max" in p.get("eventTime", {})), default=None)
    if seen is not None:
        marker = spark.range(1).select(*[(F.lit(seen).cast("timestamp") + F.expr(f"interval {late_rows_after}") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema])
        marker.write.mode("append").parquet(f"{base}/end")
        run(stream, store, f"{base}/state", mode)
    if not done:
        return spark.createDataFrame([], kind).withColumn("batch", F.lit(0))
    found = spark.read.schema(StructType([*kind, StructField("batch", IntegerType())])).parquet(f"{base}/out")
    return found.filter(F.col("batch") <= max(done))  # what a batch that never ended may have written stays out


def windowed(stream: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = stream.withWatermark("ts", late).groupBy(win.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = F.session_window("ts", gap)
    counted = stream.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "user_id", "n")


def frame_sets(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Frames of a live stream with all of color, depth and ir, by event-time window: start, n_events."""
    have = [F.max((F.col("stream") == s).cast("int")).alias(s) for s in ("color", "depth", "ir")]
    frames = stream.withColumn("stream", stream_kind(F.col("event_type"))).withWatermark("ts", late)
    out = frames.groupBy(F.window("ts", width).alias("w")).agg(F.count("stream").alias("n_events"), *have)
    return out.filter("color + depth + ir = 3").select(F.col("w.start").alias("start"), "n_events")


class FrameTimeout(StatefulProcessor):
    """A frame ends ``wait`` after its first part, in event time: complete if every stream had a part by then, else dropped.

    Parts that come later are none of the frame's. Its state goes when the watermark has passed the frame's own end.
    """

    STREAMS = ("color", "depth", "ir")

    def __init__(self, wait_ms: int, width_ms: int):
        self.wait_ms, self.width_ms = wait_ms, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "stream string", "ts long")
        self.ended = handle.getValueState("ended", "ended boolean")

    def _first(self) -> int | None:
        return min((v[0] for v in self.parts.values()), default=None) if self.parts.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._first()
        for pdf in rows:
            if self.ended.exists():
                continue
            for stream, micros in pdf.groupby("stream")["micros"].min().items():
                if not self.parts.containsKey((stream,)) or micros < self.parts.getValue((stream,))[0]:
                    self.parts.updateValue((stream,), (int(micros),))
        first = None if self.ended.exists() else self._first()
        if first is not None and first != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.wait_ms)
            self.handle.registerTimer(first // 1000 + self.wait_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            self.ended.clear()
            yield pd.DataFrame()
            return
        at = {k[0]: v[0] for k, v in self.parts.iterator()}
        first = min(at.values())
        in_time = {s: t for s, t in at.items() if t <= first + self.wait_ms * 1000}
        self.parts.clear()
        self.ended.update((True,))
        self.handle.registerTimer(key[0] // 1000 + self.width_ms)
        status = "complete" if len(in_time) == len(self.STREAMS) else "dropped"
        yield pd.DataFrame({"frame": [key[0]], "status": [status], **{f"{s}_ts": pd.array([in_time.get(s)], dtype="Int64") for s in self.STREAMS}})

    def close(self) -> None:
        pass


def frames_in_time(stream: DataFrame, wait_ms: int = 600_000, width_ms: int = 3_600_000, late: str = "1 hour") -> DataFrame:
    """frame (microseconds), status, color_ts, depth_ts, ir_ts: each frame once, when it is complete or its time is out."""
    micros = F.unix_micros("ts")
    parts = stream.withWatermark("ts", late).withColumns({"stream": stream_kind(F.col("event_type")), "micros": micros, "frame": micros - F.pmod(micros, F.lit(width_ms * 1000))})
    return parts.filter("stream IS NOT NULL OR event_type IS NULL").groupBy("frame").transformWithStateInPandas(
        statefulProcessor=FrameTimeout(wait_ms, width_ms), outputStructType="frame long, status string, color_ts long, depth_ts long, ir_ts long", outputMode="Append", timeMode="EventTime"
    )


def measured_samples(samples: DataFrame, rounds: DataFrame, longest: str = "1 day", bucket: str = "day", late: str = "1 hour") -> DataFrame:
    """Samples (ts, ...) joined to the rounds (round, start, end) that they fall in, both of them streams.

    A round is listed under each ``bucket`` of time that it touches, so the join has a key; ``longest`` bounds a round, so the
    state of either side goes when the watermarks of both have passed.
    """
    step = F.expr(f"interval 1 {bucket}")
    spread = rounds.withWatermark("start", late).withColumn("bucket", F.explode(F.sequence(F.date_trunc(bucket, "start"), F.date_trunc(bucket, F.col("end") - F.expr("interval 1 microsecond")), step)))
    keyed = samples.withWatermark("ts", late).withColumn("at", F.date_trunc(bucket, "ts"))
    inside = (F.col("at") == F.col("bucket")) & (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")) & (F.col("ts") < F.col("start") + F.expr(f"interval {longest}"))
    return keyed.join(spread, inside & (F.col("start") >= F.col("ts") - F.expr(f"interval {longest}"))).drop("at", "bucket")


class RoundState(StatefulProcessor):
    """Keeps a running weighted mean for each key across micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mean", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for pdf in rows:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        self.state.update((n, total))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "mean": [total / max(n, 1)]})

    def close(self) -> None:
        pass


def running_means(stream: DataFrame) -> DataFrame:
    by_type = stream.select("event_type", "value").groupBy("event_type")
    return by_type.transformWithStateInPandas(
        statefulProcessor=RoundState(), outputStructType="event_type string, n long, mean double", outputMode="Update", timeMode="None"
    )


class ClientState(StatefulProcessor):
    """A node's own parameters, layer by layer, from round to round.

    A message of a round has, for a layer, what the server gives and by how much the node's training moved it. Shared layers
    start from what is given, local ones from what the node has kept; either way the node keeps the result.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.layers = handle.getMapState("layers", "layer int", "w array<double>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for layer, w in zip(initialState["layer"], initialState["w"], strict=True):
            self.layers.updateValue((int(layer),), ([float(x) for x in w],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        messages = pd.concat(list(rows)).sort_values(["round", "layer"])  # a round's layers, of one node
        out = []
        for r, layer, local, given, moved in messages[["round", "layer", "is_local", "given", "moved"]].itertuples(index=False):
            kept = self.layers.getValue((int(layer),))[0] if local and self.layers.containsKey((int(layer),)) else given
            w = [float(a) + float(b) for a, b in zip(kept, moved, strict=True)]
            self.layers.updateValue((int(layer),), (w,))
            out.append((key[0], int(r), int(layer), w))
        yield pd.DataFrame(out, columns=["node", "round", "layer", "w"])

    def close(self) -> None:
        pass


def client_parameters(messages: DataFrame, initial: DataFrame) -> DataFrame:
    """(node, round, layer, is_local, given, moved) and first (node, layer, w) -> node, round, layer, w after each round."""
    return messages.groupBy("node").transformWithStateInPandas(
        statefulProcessor=ClientState(), outputStructType="node long, round int, layer int, w array<double>", outputMode="Update", timeMode="None", initialState=initial.groupBy("node")
    )


class Progress(StreamingQueryListener):
    """Keeps (query, batch, rows read) of every progress report and calls ``tell`` for each ``every`` rows or more."""

    def __init__(self, every: int = 50, tell: Callable[[int], None] | None = None):
        self.every, self.tell, self.seen, self.rows, self.told = every, tell, [], 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen.append((str(p.id), p.batchId, p.numInputRows))
        self.rows += p.numInputRows
        if self.rows - self.told >= self.every:
            self.told = self.rows
            if self.tell:
                self.tell(self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def rounds_by_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """One federated round for each micro-batch; ``step`` must be idempotent for a repeated batch id."""
    run(stream, step, checkpoint)


def versioned_rounds(stream: DataFrame, initial: DataFrame, aggregate: Callable[[DataFrame, DataFrame], DataFrame], folder: str) -> None:
    """The round loop: micro-batch k reads version k of the weights and writes version k + 1 = ``aggregate(updates, weights)``.

    Versions are folders of (layer, w). A batch that comes again, after a failure or from the checkpoint, reads the same version and
    replaces the same one, so it changes nothing; the loop goes on from the checkpoint in another session.
    """
    spark, kind = stream.sparkSession, initial.schema

    def step(updates: DataFrame, batch: int) -> None:
        now = initial if batch == 0 else spark.read.schema(kind).parquet(f"{folder}/weights/version={batch}")
        aggregate(updates, now).select(*initial.columns).write.mode("overwrite").parquet(f"{folder}/weights/version={batch + 1}")

    run(stream, step, f"{folder}/state")


def versions(spark: SparkSession, folder: str, kind) -> DataFrame:
    """All weights with their version."""
    return spark.read.schema(f"{kind}, version int").parquet(f"{folder}/weights")


def deal_rounds(table: DataFrame, path: str, rounds: list[int], then: Callable[[], None]) -> None:
    """Writes the rows of each round to the folder of a stream, and calls ``then``, which reads on from its checkpoint."""
    for r in rounds:
        table.filter(F.col("round") == r).write.mode("append").parquet(path)
        then()


def as_micros(ts: Column) -> Column:
    return F.timestamp_micros(ts).cast("timestamp_ntz")
