"""Durable intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "quillmesh-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/quillmesh"


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` and reads it back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
