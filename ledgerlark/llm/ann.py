"""Approximate nearest neighbours by several shifted Hilbert orderings of projected vectors.

Every curve projects the unit vectors to `DIMS` random orthonormal directions, shifts and quantises them, and orders them by
their Hilbert key. Spark range-partitions the keys, which gives every vector its rank on each curve. A query meets the
vectors within `window` ranks of its own on any curve, in blocks of ranks; blocks keep their best, which merge and are
ranked by the exact cosine in double precision on the original vectors.

The window is measured, not assumed: for a bounded sample of queries (CALIBRATION) the true neighbours are found among all
rows, and the window is the least that reaches `recall` of them on the best of the curves. Vectors without structure need
windows that grow with the table; clustered ones do not. All rows are indexed.

Equal vectors are one entry with its smallest ids, found in salted steps, so thousands of copies cost one entry and ties
go to smaller ids. Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length is not the most common one; a null vec_id takes no part. Rows with one vec_id are separate candidates with that
id; a query's own id is never its neighbour. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

CURVES, DIMS, BITS, CALIBRATION, BLOCK, SALT = 8, 6, 10, 64, 2048, 64
#: Queries that meet one block of candidates in one task, about, and those compared at once.
QUERIES, AT_ONCE = 16_384, 1024


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys (N,) of integer points (N, d) with `bits` bits a coordinate: neighbours on the curve are neighbours in space.

    From the top bit down, each level's sub-cube is reflected or two axes are swapped as its bits say; the bits, taken in
    Gray code across the coordinates, make the key.
    """
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(d):
            on = (x[i] & bit) != 0
            flip = np.where(on, low, 0)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= flip ^ swap
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[d - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int) -> np.ndarray:
    rng = np.random.default_rng([97, curve])
    n = unit.shape[1]
    axes = np.linalg.qr(rng.standard_normal((n, n)))[0][:, : min(DIMS, n)]
    side = 1 << BITS
    spread = 3.0 / np.sqrt(n)  # three standard deviations of a coordinate of a random unit vector
    at = (unit @ axes / spread + 1 + rng.random(axes.shape[1])) / 3 * side
    return hilbert(np.clip(at, 0, side - 1).astype(np.int64), BITS)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)


def _unit(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore"):
        square = (rows * rows).sum(1)
        odd = ~((square > 1e-280) & (square < 1e280))
        if odd.any():  # too large or too small to be squared
            rows = rows.copy()
            rows[odd] /= np.abs(rows[odd]).max(1)[:, None]
            square = (rows * rows).sum(1)
    return rows / np.sqrt(square)[:, None]


def _valid(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kept, digests = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or v is None or len(v) != n or None in v:
                continue
            a = np.array(v, np.float64) + 0.0
            if np.isfinite(a).all() and a.any():
                ids.append(i)
                kept.append(a)
                digests.append(hashlib.blake2b(a.tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.list_(pa.float64()))], ["vec_id", "digest", "vector"])


def _keyed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            unit = _unit(_matrix(batch.column(2), n))
            for curve in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), curve, np.int32)), pa.array(curve_keys(unit, curve)), *batch.columns], ["curve", "key", "cid", "query", "vector"])


def _best(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and cosine of the best `keep` allowed rows of each query; equal cosines by smaller id."""
    scores = _unit(queries) @ _unit(rows).T
    if allowed is not None:
        scores[~allowed] = -np.inf
    order = np.argsort(ids, kind="stable")
    top = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :keep]]
    found = np.take_along_axis(scores, top, 1)
    q, k = np.nonzero(found > -np.inf)
    return q, ids[top[q, k]], found[q, k]


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = 0.96, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `every`, among all rows."""
    spark, empty = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    plain = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    common = plain.filter("v is not null and vec_id is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not common or not common["n"]:
        return spark.createDataFrame([], empty)
    n = common["n"]
    rows = written(plain.mapInArrow(lambda it: _valid(it, n), "vec_id long, digest binary, vector array<double>"), "ann-rows")
    # classes of equal vectors: their k + 1 smallest ids, by salted and then whole ranking
    salted = rows.withColumn("place", F.row_number().over(Window.partitionBy("digest", F.pmod(F.xxhash64("vec_id"), F.lit(SALT))).orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    ranked = salted.withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    members = written(ranked.withColumn("cid", F.min("vec_id").over(Window.partitionBy("digest"))), "ann-members")
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "digest").distinct()
    asked = written(asked.join(members.filter("place = 1").select("digest", "cid"), "digest").drop("digest"), "ann-asked")
    entries = members.filter("place = 1").select("cid", "vector").join(asked.select("cid").distinct().withColumn("query", F.lit(True)), "cid", "left").select("cid", F.coalesce("query", F.lit(False)).alias("query"), "vector")
    keyed = entries.mapInArrow(lambda it: _keyed(it, n), "curve int, key long, cid long, query boolean, vector array<double>")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = written(keyed.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key", "cid").withColumn("mid", F.monotonically_increasing_id()), "ann-ordered")
    starts = ordered.groupBy("curve", F.shiftright("mid", 33).alias("part")).agg(F.min("mid").alias("low"), F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    # one row a partition and curve: bounded by the number of partitions
    placed = ordered.withColumn("part", F.shiftright("mid", 33)).join(F.broadcast(starts), ["curve", "part"]).select("curve", "cid", "query", "vector", (F.col("mid") - F.col("low") + F.col("offset")).alias("at"))
    placed = written(placed, "ann-placed")
    window = measured_window(placed, n, k, recall)
    data = placed.withColumn("block", F.floor(F.col("at") / BLOCK))
    low, high = F.floor(F.greatest(F.col("at") - window, F.lit(0)) / BLOCK), F.floor((F.col("at") + window) / BLOCK)
    # where many queries lie within a window, each part of them meets its own copy of the block
    asking, all_ = placed.filter("query AND curve = 0").count(), placed.filter("curve = 0").count()
    parts = max(1, -(-(2 * window + BLOCK) * asking // (max(all_, 1) * QUERIES)))
    sought = placed.filter("query").withColumn("block", F.explode(F.sequence(low, high))).withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int"))
    data = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else data.withColumn("part", F.lit(0))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        asks, at, place = _matrix(left["vector"], n), left["at"].to_numpy(), right["at"].to_numpy()
        rows_, ids, own, out = _matrix(right["vector"], n), right["cid"].to_numpy(), left["cid"].to_numpy(), []
        for begin in range(0, len(asks), AT_ONCE):
            some = slice(begin, begin + AT_ONCE)
            q, found, score = _best(asks[some], rows_, ids, np.abs(at[some][:, None] - place[None]) <= window, k + 1)
            out.append(pa.table({"q": own[some][q], "cid": found, "score": score}))
        return pa.concat_tables(out)

    found = sought.groupBy("curve", "block", "part").cogroup(data.groupBy("curve", "block", "part")).applyInArrow(rerank, "q long, cid long, score double")
    merged = found.groupBy("q", "cid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    merged = merged.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    ids = members.select("cid", "vec_id")
    named = merged.join(ids, "cid").join(asked.withColumnRenamed("cid", "q"), "q").filter("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.select("query_id", F.row_number().over(final).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def measured_window(placed: DataFrame, n: int, k: int, recall: float) -> int:
    """The least window that holds `recall` of the true k nearest entries of at most CALIBRATION queries, over all rows."""
    one = placed.filter("curve = 0")
    some = one.filter("query").orderBy(F.xxhash64("cid"), "cid").limit(CALIBRATION).select("cid", "vector").collect()
    if not some:
        return 0
    queries, own = np.array([r["vector"] for r in some]), np.array([r["cid"] for r in some])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                held.append(_best(queries, _matrix(part.column(1), n), part.column(0).to_numpy(), None, k + 1))
                if len(held) > 64:
                    held = [_smallest(held, k + 1)]
        if held:
            q, ids, score = _smallest(held, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(score)], ["q", "cid", "score"])

    found = one.select("cid", "vector").mapInArrow(exact, "q long, cid long, score double")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))).filter(F.col("r") <= k + 1).collect()
    pairs = [(int(own[r["q"]]), r["cid"]) for r in top if r["cid"] != own[r["q"]]]
    if not pairs:
        return 0
    wanted = sorted({x for pair in pairs for x in pair})
    at = {(r["curve"], r["cid"]): r["at"] for r in placed.filter(F.col("cid").isin(wanted)).select("curve", "cid", "at").collect()}
    apart = [min(abs(at[c, a] - at[c, b]) for c in range(CURVES)) for a, b in pairs]
    return int(np.quantile(apart, recall, method="higher"))


def _smallest(held: list, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, ids, score = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.searchsorted(q, q)
    some = np.arange(len(q)) - first < keep
    return q[some], ids[some], score[some]
