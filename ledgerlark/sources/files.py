"""Readers and writers of layout, outline, cell and canonical documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark import schema


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """Layout documents as JSON, one a file; a wrong type fails."""
    return spark.read.schema(schema.LAYOUT).option("mode", "FAILFAST").json(path, multiLine=True)


def lines(docs: DataFrame) -> DataFrame:
    """document, page_number, line_no, text, size, bold, fonts, bbox, page_width, page_height: blank lines left out, numbers to one decimal."""
    pages = docs.select("document", F.explode("pages").alias("p"))
    rows = pages.select("document", "p.page_number", F.col("p.width").alias("page_width"), F.col("p.height").alias("page_height"), F.posexplode("p.lines").alias("line_no", "l"))
    out = rows.select("document", "page_number", "line_no", "l.text", F.round("l.size", 1).alias("size"), "l.bold", "l.fonts", F.transform("l.bbox", lambda x: F.round(x, 1)).alias("bbox"), F.round("page_width", 1).alias("page_width"), F.round("page_height", 1).alias("page_height"))
    return out.filter(F.trim("text") != "")


def outline(docs: DataFrame) -> DataFrame:
    """document, seq, level, title, page of the embedded outline; entries that miss a part are left out."""
    rows = docs.select("document", F.posexplode("outline").alias("seq", "e"))
    return rows.select("document", "seq", "e.level", F.trim("e.title").alias("title"), "e.page").dropna(subset=["level", "title", "page"])


def cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CELLS).json(path)


def parsed_files(spark: SparkSession, path: str, parser: Callable[[bytes], list[dict]], ddl: str) -> DataFrame:
    """Binary files through a parser plug-in that gives rows of `ddl`, one file a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in ddl.split(",")]
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(parser(bytes(content)), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ddl)


def canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical documents; one without document or issuer fails when it is read."""
    rows = spark.read.schema(schema.DOCUMENT).option("mode", "FAILFAST").json(path, multiLine=True)
    whole = F.when(F.col("document").isNull() | F.col("issuer").isNull(), F.raise_error(F.lit("a canonical document needs document and issuer")).cast("boolean")).otherwise(True)
    return rows.filter(whole)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines without null fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_chunks(df: DataFrame, path: str, target: int, overlap: int) -> None:
    """Chunks, and beside them their number and the settings that made them."""
    df.write.mode("overwrite").parquet(f"{path}/chunks")
    df.agg(F.count(F.lit(1)).alias("total_chunks")).select("total_chunks", F.lit(target).alias("target_chars"), F.lit(overlap).alias("overlap_chars")).write.mode("overwrite").json(f"{path}/config")
