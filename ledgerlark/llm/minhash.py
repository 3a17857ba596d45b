"""Near-duplicate classes by one-permutation hashing with optimal densification, confirmed on whole shingle sets.

1. One pass over the texts gives each document's set of `width`-word shingles (A-Z lower-cased), a 128-bit digest of the
   set, and a one-permutation signature: the range of the hash is cut into bins, a bin keeps the least hash in it, and an
   empty bin takes the value of the first full one on its own fixed random walk over the bins (optimal densification).
2. Documents with equal sets are one node, named by the least doc_id. Links between them need no search.
3. Bands of bins are bucket keys. A bucket links every member with its least member only: a star, so n - 1 candidates.
   A candidate is confirmed on the whole sets.
4. Members of one star that lie in different components may still be linked with each other. They are compared by their
   differences from the star's centre alone, which say exactly how much two of them share: stars of up to `block` members in one
   task, larger ones split by an exact prefix filter over the rare shingles of these differences, and what is larger
   still in pairs of chunks. Only links come out, never pairs, and no member is left out.
5. Components by repeated linking to the least neighbour, in Spark jobs over the links alone.

Very long texts are read whole: their sets are held one at a time and cut by no limit. Ties do not arise: the result does not
depend on the order of rows. Null, empty and wordless texts have the empty set and link with nothing. Rows with one doc_id are one node; a null
doc_id is linked with nothing, its component is null and it is kept. An empty table gives an empty result. Only the two named
columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import U64, byte_parts, doc_groups, mixed, word_hashes
from .store import written

#: Candidate ids up to this number are broadcast as a filter of the second scan (8 bytes each); more are joined.
BROADCAST_IDS = 500_000
#: Members of a star that are compared in one task; it also holds 256 times as many items of their differences at most.
BLOCK = 4096
#: Chance that a pair at the threshold misses all bands; their number follows from it.
MISS = 2.5e-8
#: Signature values that are computed at once.
VALUES = 8_000_000
_K = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than `width` words are one shingle, none are none."""
    with np.errstate(over="ignore"):
        sums = sum((words[k : len(words) - width + 1 + k] * (_K[k % 4] + U64(2 * k)) for k in range(width)), np.zeros(max(len(words) - width + 1, 0), U64))
        sums = mixed(sums)
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= width:
                out.append(np.unique(sums[lo : hi - width + 1]))
            elif hi > lo:
                short = np.array([hi - lo], U64) * _K[3]
                for k in range(hi - lo):
                    short = mixed(short + words[lo + k] * _K[k % 4])
                out.append(short)
            else:
                out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of `bins` values for each (non-empty) set."""
    each = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    with np.errstate(over="ignore"):
        place = ((flat >> U64(32)) * U64(bins)) >> U64(32)
        key = np.repeat(np.arange(len(sets)), each) * bins + place.astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out, full = np.zeros(len(sets) * bins, U64), np.zeros(len(sets) * bins, bool)
        out[key[first]], full[key[first]] = flat[first], True
        empty, turn = np.flatnonzero(~full), 0
        while len(empty):  # ends: every set has a full bin, and each walk comes to all bins
            turn += 1
            step = mixed((empty % bins).astype(U64) * _K[0] + U64(turn) * _K[1]) % U64(bins)
            source = empty - empty % bins + step.astype(np.int64)
            hit = full[source]
            out[empty[hit]] = out[source[hit]]
            empty = empty[~hit]
    return out.reshape(len(sets), bins)


def band_keys(sig: np.ndarray, bands: int, rows: int, salt: int) -> np.ndarray:
    """bands keys a signature. Band b takes bins b * rows on, or, where bins run out, its own random choice of bins."""
    bins = sig.shape[1]
    keys = np.empty((len(sig), bands), np.int64)
    rng = np.random.Generator(np.random.PCG64(salt))
    with np.errstate(over="ignore"):
        for b in range(bands):
            chosen = np.arange(b * rows, (b + 1) * rows) if bands * rows <= bins else rng.choice(bins, rows, replace=False)
            h = np.full(len(sig), U64(b + 1) * _K[2] + U64(salt), U64)
            for c in chosen:
                h = mixed(h * _K[0] + sig[:, c])
            keys[:, b] = h.view(np.int64)
    return keys


def bands_for(threshold: int, rows: int, miss: float) -> int:
    """The least number of bands of `rows` bins which a pair at the threshold misses with a chance of `miss` at most."""
    share = (threshold / 100.0) ** rows
    return 1 if share >= 1 else math.ceil(math.log(miss) / math.log1p(-share))


def _scan(batches: Iterator[pa.RecordBatch], width: int, bins: int, bands: int, rows: int, salt: int) -> Iterator[pa.RecordBatch]:
    for batch in byte_parts(batches, 1):
        words, bounds = word_hashes(batch.column(1), fold=True)
        for lo, hi in doc_groups(bounds, 1_000_000):
            sets = shingle_sets(words[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], width)
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            keys: list = [None] * len(sets)
            digests: list = [None] * len(sets)
            at_once = max(1, VALUES // bins)
            for part in (some[k : k + at_once] for k in range(0, len(some), at_once)):
                for i, row in zip(part, band_keys(signatures([sets[i] for i in part], bins), bands, rows, salt), strict=True):
                    keys[i], digests[i] = row, hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in byte_parts(batches, 1):
        words, bounds = word_hashes(batch.column(1), fold=True)
        for lo, hi in doc_groups(bounds, 1_000_000):
            sets = shingle_sets(words[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], width)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "items"])


def _links_between(table: pa.Table, threshold: int) -> pa.Table:
    """Rows node, root, inside, side, s, delta of one block -> links a, b between different roots, one for each pair of roots.

    Two members are linked if their differences from the centre share at least (s_i + s_j) / (2 * (100 + threshold)) items. One of
    the two is outside the centre's component, so only those ask; side 1 meets side 2, and 3 stands on both sides.
    """
    node, root, side, s = (table[c].to_numpy() for c in ("node", "root", "side", "s"))
    inside = table["inside"].to_numpy().astype(bool)
    column = table["delta"].combine_chunks()
    off, items = column.offsets.to_numpy(), column.values.to_numpy()
    owner = np.repeat(np.arange(len(node)), np.diff(off))
    order = np.argsort(items[off[0] : off[-1]], kind="stable")
    ordered, owner, off = items[off[0] : off[-1]][order], owner[order], off - off[0]
    own, need, found = items[column.offsets[0].as_py() :], 2 * (100 + threshold), {}
    for i in np.flatnonzero(~inside):
        mine = own[off[i] : off[i + 1]]
        lo, hi = np.searchsorted(ordered, mine, "left"), np.searchsorted(ordered, mine, "right")
        n = hi - lo
        shared = np.bincount(owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(node))
        meets = (side == 3) if side[i] == 3 else (side | side[i]) == 3
        for j in np.flatnonzero((need * shared >= s + s[i]) & (root != root[i]) & meets):
            found.setdefault((min(root[i], root[j]), max(root[i], root[j])), (node[i], node[j]))
    return pa.table({"a": pa.array([x for x, _ in found.values()], pa.int64()), "b": pa.array([y for _, y in found.values()], pa.int64())})


def components(links: DataFrame, label: str) -> DataFrame:
    """links a, b (long) -> node, root: the least node reachable, for every node of a link.

    Alternating large-star and small-star steps: each replaces links by links to the least neighbour, so hubs never gather
    their neighbours in a list, and the number of rounds is logarithmic in practice.
    """
    # the least node is a node's parent; links always run from the larger to the smaller node
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), label)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        step = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), label)
        # done when every node has one parent and no parent has a parent
        parents = step.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        settled = parents.filter("n > 1").isEmpty() and step.join(parents.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        edges = step
        if settled:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), label)


def stars(members: DataFrame) -> DataFrame:
    """Bucket rows node, key -> a, b, many: each member b with the least member a of its bucket, so n - 1 rows a bucket at most.

    many: a is the centre of several members, so two of them may still have to be compared.
    """
    members = written(members, "near-buckets")
    heads = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last").drop("last")
    pairs = written(members.join(heads, "key").filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "near-stars")
    return pairs.join(pairs.groupBy("a").agg((F.count(F.lit(1)) > 1).alias("many")), "a")


def measured(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """a, b, many -> a, g, b, slack, s, d, delta, by the whole sets. g stands for one set of a, as rows of one doc_id may have several.

    With d the size of the symmetric difference of a and b, 100 * intersection >= threshold * union is
    slack = (100 + threshold) * d - (100 - threshold) * (size of a + size of b) <= 0. s is the same without the size of a; delta,
    the difference itself, is kept where many holds.
    """
    joined = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
    joined = joined.select("a", F.xxhash64("a", F.xxhash64("x")).alias("g"), "b", "many", F.size("x").cast("long").alias("m"), F.size("y").cast("long").alias("n"), F.array_except("y", "x").alias("more"), F.array_except("x", "y").alias("less"))
    d = (F.size("more") + F.size("less")).cast("long")
    out = joined.select("a", "g", "b", "m", "n", d.alias("d"), F.when(F.col("many"), F.concat("more", "less")).alias("delta"))
    s = f"{100 + threshold} * d - {100 - threshold} * n"
    return written(out.selectExpr("a", "g", "b", f"{s} - {100 - threshold} * m AS slack", f"{s} AS s", "d", "delta"), "near-tested")


def open_members(tested: DataFrame, roots: DataFrame) -> DataFrame:
    """g, node, root, inside, s, d, delta, s_out of the stars whose members lie in several components, so may hide links.

    Only pairs of different components matter, so at least one of the two is outside the centre's component and not linked
    with the centre. Members inside whose difference is too small to share what such a link needs are left out.
    """
    root = lambda node, name: roots.select(F.col("node").alias(node), F.col("root").alias(name))
    placed = tested.filter("delta is not null").join(root("b", "rb"), "b", "left").join(root("a", "ra"), "a", "left")
    placed = placed.withColumn("root", F.coalesce("rb", "b")).withColumn("inside", F.coalesce("ra", "a") == F.col("root"))
    placed = written(placed.select("g", F.col("b").alias("node"), "root", "inside", "s", "d", "delta"), "near-placed")
    apart = F.when(~F.col("inside"), F.col("root"))
    groups = placed.groupBy("g").agg(F.min(F.when(~F.col("inside"), F.col("s"))).alias("s_out"), F.min(apart).alias("r0"), F.max(apart).alias("r1"), F.max("inside").alias("both"))
    return placed.join(groups.filter("both or r0 < r1").drop("r0", "r1", "both"), "g").filter("s_out is not null")


def by_rare_shingles(rest: DataFrame, threshold: int) -> DataFrame:
    """Members of large stars -> key and the same columns: smaller groups, in at least one of which every link still hidden meets.

    A prefix filter. Linked members share at least o = (s_i + s_j) / (2 * (100 + threshold)) items of their differences from
    the centre; ordered from rare to common, these meet among the first d - o + 1, o taken as the least over all partners a
    member can have. Items that stand in one component only come first in this order and make no group: of copies changed
    each in its own way nothing is left. There are groups for pairs inside-outside and for pairs outside-outside.
    """
    half = 2 * (100 + threshold)
    share = lambda other: F.greatest(F.lit(1).cast("long"), F.expr(f"(s + {other} + {half - 1}) div {half}"))  # noqa: E731  rounded up
    rest = rest.withColumn("o", share("s_out")).filter("o <= d")
    inner = rest.filter("inside").groupBy("g").agg(F.min("s").alias("s_in"), F.max("d").alias("d_in"))
    rest = rest.join(inner, "g", "left").withColumn("o_in", F.when(F.col("inside"), F.col("o")).when(share("s_in") <= F.least("d", "d_in"), share("s_in")))
    rest = written(rest.withColumn("o_out", F.when(~F.col("inside"), F.col("o"))).drop("o", "s_in", "d_in"), "near-large")
    items = rest.select("g", "node", "root", "inside", "o_in", "o_out", F.explode("delta").alias("item"))
    apart = F.when(~F.col("inside"), F.col("root"))
    common = items.groupBy("g", "item").agg(F.count(F.lit(1)).alias("df"), F.max("inside").alias("within"), F.min(apart).alias("r0"), F.max(apart).alias("r1"))
    common = common.select("g", "item", "df", (F.col("within") & F.col("r0").isNotNull()).alias("mixed"), F.coalesce(F.col("r0") < F.col("r1"), F.lit(False)).alias("several")).filter("mixed or several")
    found, made = items.join(common, ["g", "item"]), []
    for bound, live in (("o_in", "mixed"), ("o_out", "several")):
        some = found.filter(F.col(live) & F.col(bound).isNotNull()).groupBy("g", "node", bound).agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("l"))
        some = some.filter(F.size("l") >= F.col(bound)).withColumn("l", F.slice("l", F.lit(1), (F.size("l") - F.col(bound) + 1).cast("int")))
        made.append(some.select("g", "node", F.explode("l.item").alias("item")).select("g", "node", F.xxhash64("g", "item", F.lit(bound)).alias("key")))
    return made[0].unionByName(made[1]).join(rest, ["g", "node"]).select("key", "node", "root", "inside", "s", "delta")


def in_blocks(members: DataFrame, threshold: int, most: int, label: str) -> DataFrame:
    """key, node, root, inside, s, delta -> links a, b between different roots of a key.

    A block holds two chunks of a key's members, a chunk `most` members or 256 * `most` items at most; keys up to one chunk are one block.
    """
    groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("delta")).alias("items"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("inside").alias("inside"))
    groups = groups.filter("r0 < r1 and not inside").select("key", F.ceil(F.greatest(F.col("n") / most, F.col("items") / (256 * most))).cast("int").alias("chunks"))
    members = members.join(groups.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "root", "inside", "s", "delta", side.alias("side"))
    return written(dealt.groupBy("key", "x", "y").applyInArrow(lambda t: _links_between(t, threshold), "a long, b long"), label)


def near_duplicates(docs: DataFrame, threshold: int = 85, width: int = 3, bands: int | None = None, rows: int = 5, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row. Links: 100 * intersection >= threshold * union.

    Unless given, the number of bands follows from the threshold (MISS): 30 of 5 at 85 %, 45 at 80 %.
    """
    bands = bands or bands_for(threshold, rows, MISS)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scanned = written(source.mapInArrow(lambda it: _scan(it, width, bands * rows, bands, rows, 1), "doc_id long, n_shingles long, digest binary, keys array<long>"), "near-scan")
    full = scanned.filter("doc_id is not null and n_shingles > 0")
    nodes = written(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "near-nodes")
    # one doc_id on several rows joins their nodes
    doubled = full.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    same_id = full.select("doc_id", "digest").join(doubled, "doc_id", "left_semi").join(nodes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    pairs = stars(nodes.select("node", F.explode("keys").alias("key")))
    ids = written(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id"), "near-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = written(source.join(wanted, "doc_id", "left_semi").mapInArrow(lambda it: _sets(it, width), "doc_id long, items array<long>"), "near-sets")
    tested = measured(pairs, sets, threshold)
    links = tested.filter("slack <= 0").select("a", "b").union(same_id)
    roots = components(links, "near-roots")
    rest = written(open_members(tested, roots), "near-open")
    if not rest.isEmpty():
        large = rest.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("items")).filter((F.col("n") > block) | (F.col("items") > 256 * block)).select("g")
        few = rest.join(large, "g", "left_anti").select(F.col("g").alias("key"), "node", "root", "inside", "s", "delta")
        more = in_blocks(few, threshold, block, "near-block-links")
        if not large.isEmpty():
            many = written(by_rare_shingles(rest.join(large, "g", "left_semi"), threshold), "near-rare")
            more = more.union(in_blocks(many, threshold, block, "near-rare-links"))
        found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(found.union(more), "near-roots-all")
    named = nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component"))
    out = scanned.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that a smaller doc_id stands for; of several rows with one doc_id, the least row stays."""
    spare = written(near_duplicates(docs, **options).filter("not kept").select("doc_id").distinct(), "near-spare")
    left = docs.join(F.broadcast(spare) if spare.count() <= BROADCAST_IDS else spare, "doc_id", "left_anti").select(*docs.columns)
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if again.isEmpty():
        return left
    first = left.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*[c for c in docs.columns if c != "doc_id"])))
    return first.filter("_n = 1 or doc_id is null").drop("_n")
