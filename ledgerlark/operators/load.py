"""Idempotent loading by natural keys: update-or-insert, insert-if-absent, category rows and provenance rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], seq: str | None = None) -> DataFrame:
    """One row a key: the new row whole, its nulls too, where there is one, else the old row. Null keys are keys.

    Of several new rows of a key the last by seq stays, without seq (and among ties) the greatest by the columns.
    """
    kind = dict(new.dtypes)[seq] if seq else "int"
    side = lambda rows, n, s: rows.select(*keys, F.struct(*columns).alias("_r"), F.lit(n).alias("_n"), s.cast(kind).alias("_s"))
    both = side(old, 0, F.lit(None)).unionByName(side(new, 1, F.col(seq) if seq else F.lit(None)))
    last = both.groupBy(*keys).agg(F.max(F.struct("_n", "_s", "_r")).alias("_l"))
    return last.select(*keys, *[F.col(f"_l._r.{c}").alias(c) for c in columns])


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """old and the first new row of every key that old does not have."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in old.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), seq) if seq else F.min(F.struct(*rest))
    first = fresh.groupBy(*keys).agg(pick.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]) if rest else fresh.select(*keys).distinct()
    return old.unionByName(first.select(*old.columns))


def exploded_categories(rows: DataFrame, column: str) -> DataFrame:
    """A row for each part of a compound category (I_II), sharing its values."""
    from ledgerlark.functions.text import category_parts

    return rows.withColumn("category_code", F.explode(category_parts(F.col(column))))


def categories(seed: DataFrame, codes: DataFrame) -> DataFrame:
    """seed and a row `Category <code>` for every code without one."""
    new = codes.select("category_code").distinct().withColumn("category_name", F.concat(F.lit("Category "), "category_code"))
    return inserted_if_absent(seed, new, ["category_code"])


def provenance_rows(rows: DataFrame, key: str, page: str, fields: list[str]) -> DataFrame:
    """Distinct (key, page, source_field): one for the row itself and one for every field that has a value."""
    own = [F.lit("series"), *[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]]
    return rows.select(key, F.col(page).alias("page_number"), F.explode(F.array_compact(F.array(*own))).alias("source_field")).distinct()


def replaced(df: DataFrame, path: str) -> None:
    """Write beside, then swap by two renames. Between them the path is missing; recovered() mends that after a crash."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    beside, gone = f"{path}.{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(gone))
    fs.rename(hadoop(beside), hadoop(path))
    fs.delete(hadoop(gone), True)


def recovered(spark, path: str) -> None:
    """If a swap broke off between its renames, put back the rows that were there; loading again brings the new ones."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        kept = sorted(str(f.getPath()) for f in fs.globStatus(hadoop(f"{path}.old-*")) or [])
        if kept:
            fs.rename(hadoop(kept[-1]), hadoop(path))


def merge_into(spark, path: str, new: DataFrame, keys: list[str], update: bool) -> None:
    """Load new into the table at path, made if absent; loading the same rows again changes nothing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    recovered(spark, path)
    if not fs.exists(hadoop(path)):
        new.limit(0).write.parquet(path)
    old = spark.read.schema(new.schema).parquet(path)
    columns = [c for c in new.columns if c not in keys]
    out = upserted(old, new, keys, columns) if update else inserted_if_absent(old, new, keys)
    replaced(out, path)
