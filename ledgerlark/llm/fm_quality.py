"""Document quality by a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): every pair of features
interacts through low-rank factors, in time linear in the features by the sum-of-squares identity.

Features of a whole text: its words (A-Z lower-cased), hashed to `BUCKETS`, weighing log(1 + count) and scaled to unit
length; and statistics of bytes, words and lines, each cut at the training sample's deciles into steps (a step is a
feature). Labels: the mean of `labels.quality` by document. Trained in numpy with AdaGrad on at most about `sample_size`
(SAMPLE) labelled documents, taken by a hash of the id; held-out documents never take part.

Null and empty texts have statistics only and are scored like any other. Without labels every score is 0.5. Empty tables
give an empty result; null labels and ids are not learned from; repeated rows are scored as often as they occur; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import U64, doc_groups, slices, text_buffer, word_hashes
from .gru import sigmoid
from .langid import remainder

BUCKETS, RANK, SAMPLE, STEPS = 1 << 16, 8, 6000, 10
_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "line": [10], "symbol": [ord(c) for c in "#*$%&|<>=_{}[]\\/@~^"], "stop": [ord(c) for c in ".!?"], "comma": [ord(c) for c in ",;:"], "wide": range(128, 256)}
_KIND = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(_KINDS.values(), 1):
    _KIND[list(_bytes)] = _i
STATS = [*_KINDS, "bytes", "words", "word_bytes", "distinct", "top_word", "repeat_pairs", "line_words", "dup_lines"]


def _counts_by_kind(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bytes of each kind (rows) in each text (columns)."""
    n = len(off) - 1
    out = np.zeros((len(_KINDS) + 1, n), np.int64)
    for lo, hi in slices(data, off):
        a, b = np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, hi, "left")
        cuts = np.clip(off[a : b + 1], lo, hi) - lo
        owner = np.repeat(np.arange(b - a), np.diff(cuts))
        table = np.bincount(owner * 16 + _KIND[data[lo:hi]], minlength=(b - a) * 16).reshape(b - a, 16)
        out[:, a:b] += table[:, : len(_KINDS) + 1].T
    return out[1:]


def _line_stats(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines that are not blank, and those equal to an earlier one of their text."""
    lines, dups = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    for i in range(len(off) - 1):
        seen: set[int] = set()
        for line in data[off[i] : off[i + 1]].tobytes().split(b"\n"):
            if line.strip(b" \t\x0b\x0c\r"):
                lines[i] += 1
                key = hash(line)
                dups[i] += key in seen
                seen.add(key)
    return lines, dups


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bounds, word buckets and weights end to end, and statistics (texts, STATS)."""
    data, off = text_buffer(column)
    n, (words, bounds) = len(off) - 1, word_hashes(column, fold=True)
    kinds = _counts_by_kind(data, off)
    lines, dups = _line_stats(data, off)
    size, many = np.diff(off).astype(float), np.diff(bounds).astype(float)
    safe, some = np.maximum(size, 1), np.maximum(many, 1)
    index, weight, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], np.zeros(n + 1, np.int64)
    distinct, top, pairs = np.zeros(n), np.zeros(n), np.zeros(n)
    for lo, hi in doc_groups(bounds, 500_000):
        part = words[bounds[lo] : bounds[hi]]
        owner = np.repeat(np.arange(lo, hi), np.diff(bounds[lo : hi + 1]))
        key, count = np.unique(owner * BUCKETS + (part >> U64(48)).astype(np.int64), return_counts=True)
        doc, w = key // BUCKETS, np.log1p(count).astype(np.float32)
        norm = np.sqrt(np.bincount(doc, w * w, minlength=n))
        index.append(key % BUCKETS)
        weight.append((w / norm[doc]).astype(np.float32))
        sizes = np.bincount(doc, minlength=n)
        ends[1:] += np.cumsum(sizes)
        distinct += sizes
        np.maximum.at(top, doc, count)
        if len(part) > 1:
            with np.errstate(over="ignore"):
                two = part[:-1] * U64(0x9E3779B97F4A7C15) + part[1:]
            same = owner[:-1] == owner[1:]
            np.add.at(pairs, _repeated(owner[:-1][same], two[same]), 1)
    stats = [*(k / safe for k in kinds), np.log1p(size), np.log1p(many), (size - kinds[3]) / some, distinct / some, top / some, pairs / some, many / np.maximum(lines, 1), dups / np.maximum(lines, 1)]
    return ends, np.concatenate(index), np.concatenate(weight), np.stack(stats, 1)


def _repeated(owner: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The text of every word pair that repeats an earlier one of its text."""
    order = np.lexsort((two, owner))
    o, t = owner[order], two[order]
    return o[1:][(o[1:] == o[:-1]) & (t[1:] == t[:-1])]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, index, weight, stats = features(batch.column(1))
        cut = lambda x, kind: pa.array([x[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(kind))
        yield pa.RecordBatch.from_arrays([batch.column(0), cut(index.astype(np.int32), pa.int32()), cut(weight, pa.float32()), pa.array(list(stats), pa.list_(pa.float64()))], ["doc_id", "index", "weight", "stats"])


class Machine:
    """w0, w, v over BUCKETS words and STEPS steps of each statistic."""

    def __init__(self, edges: np.ndarray, params: dict[str, np.ndarray]):
        self.edges, self.p = edges, params

    def _steps(self, stats: np.ndarray) -> np.ndarray:
        """The feature of the step in which each statistic lies."""
        return np.stack([BUCKETS + j * STEPS + np.searchsorted(self.edges[j], stats[:, j]) for j in range(stats.shape[1])], 1)

    def raw(self, ends: np.ndarray, index: np.ndarray, weight: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score before the sigmoid, and sum_i v_i x_i; all statistics have the value 1 / sqrt(their number)."""
        n, k, x = len(ends) - 1, steps.shape[1], np.float32(1 / np.sqrt(steps.shape[1]))
        w, v = self.p["w"], self.p["v"]
        s, q, lin = v[steps].sum(1) * x, (v[steps] ** 2).sum(1) * x * x, w[steps, 0].sum(1) * x
        some = np.flatnonzero(np.diff(ends))
        if len(some):
            vx = v[index] * weight[:, None]
            s[some] += np.add.reduceat(vx, ends[some], axis=0)
            q[some] += np.add.reduceat(vx * vx, ends[some], axis=0)
            lin[some] += np.add.reduceat(w[index, 0] * weight, ends[some])
        return self.p["w0"][0, 0] + lin + 0.5 * (s * s - q).sum(1), s

    def scores(self, ends: np.ndarray, index: np.ndarray, weight: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(ends, index, weight, self._steps(stats))[0].astype(np.float64))

    @classmethod
    def trained(cls, rows: list, epochs: int = 12, batch: int = 128, seed: int = 5) -> Machine | None:
        """rows: index, weight, stats, y."""
        rows = sorted(rows, key=lambda r: r["doc_id"])
        if not rows:
            return None
        stats, y = np.array([r["stats"] for r in rows]), np.array([r["y"] for r in rows], np.float32)
        index, weight = [np.array(r["index"], np.int64) for r in rows], [np.array(r["weight"], np.float32) for r in rows]
        edges = np.quantile(stats, np.arange(1, STEPS) / STEPS, axis=0).T
        rng, size = np.random.default_rng(seed), BUCKETS + stats.shape[1] * STEPS
        base = min(max(float(y.mean()), 0.01), 0.99)
        p = {"w0": np.full((1, 1), np.log(base / (1 - base)), np.float32), "w": np.zeros((size, 1), np.float32), "v": (0.05 * rng.standard_normal((size, RANK))).astype(np.float32)}
        self, rate = cls(edges, p), 0.1
        steps, x = self._steps(stats), np.float32(1 / np.sqrt(stats.shape[1]))
        seen = {"w": np.zeros((size, 1), np.float32), "v": np.zeros((size, RANK), np.float32)}
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                ends = np.concatenate([[0], np.cumsum([len(index[i]) for i in some])])
                ix, wt, st = np.concatenate([index[i] for i in some]), np.concatenate([weight[i] for i in some]), steps[some]
                raw, s = self.raw(ends, ix, wt, st)
                d = (sigmoid(raw) - y[some]).astype(np.float32) / len(some)
                owner = np.concatenate([np.repeat(np.arange(len(some)), np.diff(ends)), np.repeat(np.arange(len(some)), st.shape[1])])
                feature, value = np.concatenate([ix, st.ravel()]), np.concatenate([wt, np.full(st.size, x, np.float32)])
                used, place = np.unique(feature, return_inverse=True)
                gw, gv = np.zeros((len(used), 1), np.float32), np.zeros((len(used), RANK), np.float32)
                pull = (d[owner] * value)[:, None]
                np.add.at(gw, place, pull)
                np.add.at(gv, place, pull * (s[owner] - p["v"][feature] * value[:, None]))
                p["w0"] -= rate * d.sum()
                for name, g in (("w", gw), ("v", gv)):  # AdaGrad on the features of the batch
                    g = g + 1e-5 * p[name][used]
                    seen[name][used] += g * g
                    p[name][used] -= rate * g / (np.sqrt(seen[name][used]) + 1e-6)
        return self


def _scored(batches: Iterator[pa.RecordBatch], machine: Machine | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = machine.scores(*features(batch.column(1))) if machine and len(batch) else np.full(len(batch), 0.5)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])


def fitted(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE) -> Machine | None:
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y")).filter(remainder("doc_id", 4) != 2)
    n = known.count()
    if not n:
        return None
    place = F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1_000_000))
    some = F.broadcast(known.filter(place < int(1_000_000 * min(1.0, sample_size / n))).orderBy(place, "doc_id").limit(2 * sample_size))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, "doc_id", "left_semi")
    rows = found.mapInArrow(_rows, "doc_id long, index array<int>, weight array<float>, stats array<double>").join(some, "doc_id")
    return Machine.trained([r.asDict() for r in rows.orderBy("doc_id", "index", "weight").limit(4 * sample_size).toLocalIterator()])


def scored(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE) -> DataFrame:
    """doc_id, score of every whole text."""
    machine = fitted(docs, labels, sample_size)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _scored(it, machine), "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_size: int = SAMPLE) -> DataFrame:
    return scored(docs, labels, sample_size).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
