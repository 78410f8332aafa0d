"""Helpers of the training-data operators: shared folders, written intermediate tables, ASCII folding, fold numbers."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where that is unset on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "quillmesh-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillmesh/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of columns given as lists or arrays."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only. ASCII-only texts take the fast built-in; others go character by character."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table carries, names that differ in case too."""
    plain, at = positional(df, *names)
    return plain.select(*at).toDF(*names)


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ... by place, and what ``names`` are called now.

    Helper columns can then clash with nothing, whatever the table carries, upper-case forms of a name too; ``toDF`` with
    the old names goes back.
    """
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), [f"c{df.columns.index(n)}" for n in names]
