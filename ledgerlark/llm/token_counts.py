"""Exact token counts for every context limit, from one histogram of encoded lengths.

Documents are encoded whole and aggregated by length: one row a length, whatever the number of documents. Suffix sums
over the histogram then give, for every limit L that is a length: documents and tokens up to and beyond L, the share of
documents that fit (its quantile), and the total when every document is cut to L. Sums run inside blocks of lengths and over the
block totals, so no task holds the whole histogram.

Null and empty texts have length 0 and count as documents. An empty table gives an empty result; repeated rows count as
often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec, vocabulary_path
from .store import written

BLOCK = 1024


def _lengths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = codec(path)
    for batch in batches:
        counts = [sum(len(part) for part in coder.encode(x.as_py() or "")) // 4 for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])


def histogram(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: the number of documents of each encoded length."""
    where = path or vocabulary_path()
    lengths = docs.select(docs[text].alias("text")).mapInArrow(lambda it: _lengths(it, where), "n_tokens long")
    return written(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "length-histogram")


def totals(lengths: DataFrame) -> DataFrame:
    """For every length as a limit: n_docs, docs_upto, docs_over, tokens_upto, tokens_over, share_upto, truncated_total."""
    rows = lengths.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    suffix = lambda c, later_c: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(later_c)
    out = rows.join(blocks, "block").withColumn("docs_over", suffix("n_docs", "later_docs")).withColumn("tokens_over", suffix("tokens", "later_tokens"))
    upto, fit = F.col("all_docs") - F.col("docs_over"), F.col("all_tokens") - F.col("tokens_over")
    return out.select("n_tokens", "n_docs", upto.alias("docs_upto"), "docs_over", fit.alias("tokens_upto"), "tokens_over", (upto / F.col("all_docs")).alias("share_upto"), (fit + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"))


def quantile(summed: DataFrame, share: float) -> DataFrame:
    """The least length within which the share of all documents fits."""
    return summed.filter(F.col("share_upto") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def truncated(summed: DataFrame, limit: int) -> DataFrame:
    """The total of tokens when every document is cut to any limit, not only one that is a length."""
    below = F.max(F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "tokens_upto", "docs_over"))).alias("b")
    found = summed.agg(below, F.max(F.col("docs_upto") + F.col("docs_over")).alias("n"))
    return found.select(F.coalesce(F.col("b.tokens_upto") + limit * F.col("b.docs_over"), limit * F.col("n"), F.lit(0)).alias("total"))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    return totals(histogram(docs, path))
