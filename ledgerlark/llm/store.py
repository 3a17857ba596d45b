"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local folder only where that is unset and the master local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "ledgerlark-shared")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on this session's Arrow batches end at about `size` bytes, not at 64 MB or 10,000 rows.

    Two tasks of an executor hold a batch each, in Python and, while it is filled, twice over beside the JVM's heap; a row
    larger than `size` is a batch of its own. Which rows share a batch changes no result of the queries that ask for this.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(df: DataFrame, label: str, group: int = 0) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lost executor then costs no recomputation.

    With `group`, a row group ends at about so many bytes, looked at after every row. Parquet's own first look is after 100 rows
    and its groups have 128 MB; a writer holds the group that is open, and a reader up to 4,096 of its rows at once.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    sizes = {"parquet.block.size": group, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1000} if group else {}
    df.write.options(**sizes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
