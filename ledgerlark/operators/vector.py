"""Filtered exact cosine search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Embed = Callable[[str], list[float]]
#: Queries and rows that meet in one block.
QUERIES, ROWS = 1024, 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(rows: DataFrame, query: list[float], k: int = 8, cap: int = 200, threshold: float | None = None, vector: str = "embedding", key: str = "vec_id", filters: dict[str, object] | None = None) -> DataFrame:
    """Payload filters before scoring, then the threshold (inclusive), then the best min(k, cap) by score and key."""
    for name, value in (filters or {}).items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    at = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("score", cosine(F.col(vector), at))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(min(k, cap))


def top_k_of_each(queries: DataFrame, rows: DataFrame, k: int = 8, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, key, score, rank: the k best of rows for each query (query_id, vector).

    Every block of queries meets every block of rows, and only k rows a block and query go on. Keys may be of any type with an order.
    """
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "key": dict(rows.dtypes)[key]}
    asked, held = queries.select("query_id", vector), rows.select(key, vector)
    across, down = (max(1, -(-frame.count() // size)) for frame, size in ((asked, QUERIES), (held, ROWS)))
    place = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("x", place("query_id", across)).withColumn("y", every(down))
    held = held.withColumn("y", place(key, down)).withColumn("x", every(across))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"][:0], "key": right[key][:0], "score": np.zeros(0)})
        q, x = (np.stack([np.asarray(v, float) for v in frame[vector]]) for frame in (left, right))
        scores = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
        most = min(k, scores.shape[1])
        least = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
        at, to = np.nonzero(~(scores < least[:, None]))
        found = pd.DataFrame({"query_id": left["query_id"].to_numpy()[at], "key": right[key].to_numpy()[to], "score": scores[at, to]})
        return found.sort_values(["query_id", "score", "key"], ascending=[True, False, True]).groupby("query_id").head(k)

    found = asked.groupBy("x", "y").cogroup(held.groupBy("x", "y")).applyInPandas(best, f"query_id {kinds['query_id']}, key {kinds['key']}, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))).filter(F.col("rank") <= k)


def hashing_embedder(size: int = 64) -> Embed:
    """The default where no model is at hand: signed hashes of the words, scaled to unit length."""

    def embed(text: str) -> list[float]:
        out = np.zeros(size)
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % size] += 1.0 if h >> 63 else -1.0
        return list(out / (np.linalg.norm(out) or 1.0))

    return embed


def embedding_of(c: Column, embed: Embed) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: [float(x) for x in embed(t or "")]), "array<float>")(c)


def embedded(chunks: DataFrame, embed: Embed, text: str = "text") -> DataFrame:
    """chunks with text, blank ones left out, and their embedding."""
    return chunks.filter(F.trim(text) != "").withColumn("embedding", embedding_of(F.col(text), embed))


def stored(chunks: DataFrame, embed: Embed, path: str, document: str = "document_name") -> None:
    """Embed chunks into the store at path, one folder a document: all that was stored of these documents goes, other documents stay.

    A document whose chunks are all blank keeps one row without a chunk id, by which its old rows are overwritten too; held() leaves it out.
    """
    rows = embedded(chunks, embed)
    blank = chunks.select(document).distinct().join(rows.select(document).distinct(), document, "left_anti")
    out = rows.unionByName(blank, allowMissingColumns=True)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(document).parquet(path)


def held(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the store, to be searched by top_k and top_k_of_each."""
    return spark.read.parquet(path).filter("chunk_id IS NOT NULL")
