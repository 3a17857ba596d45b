"""Cutting lineage through the folder that all executors share; partitions that follow the rows."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task after spread, about.
ROWS = 1_000_000


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read again; a local folder only where that is unset and the master local."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "ledgerlark-shared")
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of so many rows, by hash of the keys: spark.sql.shuffle.partitions at least, and as many more as leave a task about ROWS of them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // ROWS)), *keys)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on this session's Arrow batches end at about `size` bytes, not at 64 MB or 10,000 rows; a larger row is one of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def sorted_groups(spark: SparkSession) -> None:
    """From now on this session groups rows that lie in the groups' order as they come: no partial groups are made, kept in a table and put together again."""
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
