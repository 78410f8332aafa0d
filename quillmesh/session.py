"""Session builder shared by the tests, the bench and scripts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "quillmesh", cores: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster use the session that the cluster gives instead.

    Anything in ``conf`` (dots written as double underscores) overrides the defaults below.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions or 8),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("QUILLMESH_DRIVER_MEMORY", "8g"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="quillmesh-wh-"),
        "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="quillmesh-cp-"),
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
