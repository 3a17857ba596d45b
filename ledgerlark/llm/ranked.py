r"""Ranked lexical search by impact-ordered postings, score at a time.

Spark deals the documents; every partition of the scan is an index of its own. Two passes:

* One reads the texts and writes, for every document, its length and the frequencies of the terms that are asked. Sums over
  these rows give the corpus' statistics (documents, terms, document frequencies), the same for all partitions.
* The other reads these short rows. A partition groups its postings by term and exact impact (weight times the saturated
  frequency, an integer). For an item, groups are processed in falling order of impact, whole groups at a time, into
  accumulators of integers. The bound of what is left is the sum, over the item's terms, of the next group's impact. It
  stops only when no document outside a short list of candidates can reach the k-th score any more, those that tie included;
  then the candidates' scores are completed from their own rows. So a partition's k best are exact.

The k best of the partitions meet by item, in salted steps. Documents never move between tasks.

Terms are maximal runs of letters, digits and anything beyond ASCII; A-Z count as a-z. Null and empty texts have no term and
do not count. Every row is a document of its own: repeated rows are ranked each, equal scores by doc_id, a null doc_id last.
Rows of one item_id are one item with all their terms; a null item_id is an item, one without terms finds nothing. Very long
texts are read whole, in slices. Empty tables give an empty result; other columns are ignored.

The items' terms go to all tasks, in blocks of at most `TERMS` (item, term) rows, however many items there are: the short rows
are then read once a block.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import byte_parts
from .store import written

#: (item, term) rows that go to all tasks at once; postings of an index; bytes of a text that are split at once; salts of an item.
TERMS, POSTINGS, SLICE, SALT = 500_000, 2_000_000, 1 << 22, 32
#: What a document's score is made of: fixed values of the contract.
SCALE, STEEP, FLAT, SHARE = 1_000_000_000, 1000, 20, 50
#: Candidates among which the search stops: as many as k of them, or a share of the index's documents.
CANDIDATES, OF_ALL = 8, 64

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_PLACES = np.linspace(0, 1, 33)
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """All terms in order, some millions of bytes at a time; a longer term stays whole."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(_LETTERS).split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    for batch in byte_parts(batches, 1):
        sizes, ids, tfs = [], [], []
        for text in batch.column(1).cast(pa.binary()):
            n, found = 0, Counter()
            for some in terms_of(text.as_py() or b""):
                n += len(some)
                found.update(filter(number.__contains__, some))
            sizes.append(n)
            ids.append([number[t] for t in found])
            tfs.append(list(found.values()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "ids", "tfs"])


def term_array(text: Column) -> Column:
    """Distinct terms of a text, as Column: the same as `terms_of`."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.array_distinct(F.split(plain, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), "")


class Index:
    """Postings of some documents by term and falling impact, and by document."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(bounds))
        norm = 100 - SHARE + (SHARE * sizes * n_docs) // max(n_terms, 1)
        impacts = weights[terms] * ((SCALE * tfs) // (STEEP * tfs + FLAT * norm[docs]))
        self.ids, self.bounds, self.terms, self.impacts = ids, bounds, terms, impacts
        order = np.lexsort((docs, -impacts, terms))
        self.by_docs, self.by_impacts = docs[order], impacts[order]
        self.rising = -self.by_impacts  # for binary search
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.scores = np.zeros(len(ids), np.int64)

    def completed(self, some: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of documents from their own rows. asked: whether a term is the item's."""
        sizes = self.bounds[some + 1] - self.bounds[some]
        at = np.repeat(self.bounds[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        upto = np.concatenate([[0], np.cumsum(np.where(asked[self.terms[at]], self.impacts[at], 0))])
        ends = np.cumsum(sizes)
        return upto[ends] - upto[ends - sizes]

    def best(self, item: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best of an item's terms, all that tie with the k-th included, and perhaps others."""
        ranges = [(int(self.starts[t]), int(self.starts[t + 1])) for t in item.tolist()]
        at = np.array([a for a, b in ranges if b > a], np.int64)
        ends = np.array([b for a, b in ranges if b > a], np.int64)
        scores = self.scores
        scores[:] = 0
        few = max(CANDIDATES * k, len(scores) // OF_ALL)
        while len(at):
            # whole groups of one impact, from the highest: so far down that about a sixth of what is left is read
            floor = self._floor(at, ends)
            stops = np.array([a + int(np.searchsorted(self.rising[a:b], -floor, "right")) for a, b in zip(at.tolist(), ends.tolist())])
            for a, b in zip(at.tolist(), stops.tolist()):
                if b > a:
                    scores[self.by_docs[a:b]] += self.by_impacts[a:b]  # a document stands once in a term's postings
            at, ends = stops[stops < ends], ends[stops < ends]
            if not len(at):
                break
            left = int(self.by_impacts[at].sum())
            kth = int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0
            if kth > left:  # nothing unseen can come in
                some = np.flatnonzero(scores + left >= kth)
                if len(some) <= few:
                    return some, self.completed(some, asked)
        some = np.flatnonzero(scores > 0)
        if len(some) > k:
            some = some[scores[some] >= np.partition(scores[some], -k)[-k]]
        return some, scores[some]

    def _floor(self, at: np.ndarray, ends: np.ndarray) -> int:
        """An impact that about a sixth of the postings that are left reaches, and the highest at least."""
        spots = self.by_impacts[at[:, None] + ((ends - at - 1)[:, None] * _PLACES).astype(np.int64)].ravel()
        weight = np.repeat((ends - at) / len(_PLACES), len(_PLACES))
        order = np.argsort(-spots)
        place = min(int(np.searchsorted(np.cumsum(weight[order]), (ends - at).sum() / 6)), len(order) - 1)
        return int(min(spots[order[place]], self.by_impacts[at].max()))


def _searched(batches: Iterator[pa.RecordBatch], weights: np.ndarray, items: list[np.ndarray], n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    asked = np.zeros(len(weights), bool)
    for rows in _indexes(batches):
        ids = rows.column("doc_id").combine_chunks()
        lists, tfs = rows.column("ids").combine_chunks(), rows.column("tfs").combine_chunks()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        index = Index(ids, rows.column("n").to_numpy(), bounds - bounds[0], lists.flatten().to_numpy(), tfs.flatten().to_numpy(), weights, n_docs, n_terms)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for number, item in enumerate(items):
            asked[item] = True
            some, scores = index.best(item, asked, k)
            asked[item] = False
            ordered = np.argsort(-scores, kind="stable")
            if len(ordered) > k:  # those that tie with the k-th: the smallest ids
                least = scores[ordered[k - 1]]
                names = ids.take(pa.array(some)).to_pylist()
                ordered = sorted(np.flatnonzero(scores >= least).tolist(), key=lambda x: (-scores[x], names[x] is None, names[x] or 0))[:k]
            some, scores = some[ordered], scores[ordered]
            some, scores = some[scores > 0], scores[scores > 0]
            found.append((np.full(len(some), number, np.int32), some, scores))
        if found:
            number, some, scores = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(number), ids.take(pa.array(some)), pa.array(scores)], ["item", "doc_id", "score"])


def _indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The partition's rows in tables of about `POSTINGS` postings."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(2).flatten()) + len(batch)
        if n >= POSTINGS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the k highest-scoring documents of every item."""
    spark = docs.sparkSession
    empty = "item_id long, rank int, doc_id long, score long"
    asked = written(items.select(F.col(item_id).cast("long").alias("item_id"), F.explode(term_array(F.col(item_text))).alias("term")).distinct(), "ranked-asked")
    blocks = max(1, -(-asked.count() // TERMS))
    parts = []
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect() if blocks > 1 else asked.collect()
        if rows:
            parts.append(_block(docs, rows, k, doc_id, text))
    if not parts:
        return spark.createDataFrame([], empty)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("r") <= k)
    final = Window.partitionBy("item_id").orderBy(*order)
    return salted.select("item_id", F.row_number().over(final).alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)


def _block(docs: DataFrame, rows: list, k: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({r["term"] for r in rows})
    number = {t.encode(): i for i, t in enumerate(terms)}
    names: list[int | None] = sorted({r["item_id"] for r in rows}, key=lambda x: (x is None, x or 0))
    place = {x: i for i, x in enumerate(names)}
    lists: list[list[int]] = [[] for _ in names]
    for r in rows:
        lists[place[r["item_id"]]].append(number[r["term"].encode()])
    items = [np.array(sorted(x), np.int64) for x in lists]
    counted = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(lambda it: _counted(it, number), "doc_id long, n long, ids array<int>, tfs array<long>")
    counted = written(counted, "ranked-counted")
    sums = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"]
    df = np.zeros(len(terms), np.int64)
    for i, n in counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # the block's terms at most
        df[i] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    found = counted.filter(F.size("ids") > 0).select("doc_id", "n", "ids", "tfs").mapInArrow(lambda it: _searched(it, weights, items, n_docs, n_terms, k), "item int, doc_id long, score long")
    known = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "item int, item_id long")
    return found.join(F.broadcast(known), "item").select("item_id", "doc_id", "score", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALT)).alias("salt"))


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
n AS (SELECT d, doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS all_terms FROM n),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM n) WHERE term IN (SELECT term FROM q) GROUP BY d, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (
  SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // all_terms))) AS impact FROM p JOIN n USING (d) JOIN w USING (term), c),
r AS (SELECT item_id, d, doc_id, sum(impact)::BIGINT AS score FROM q JOIN s USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM r QUALIFY rank <= 50
"""
