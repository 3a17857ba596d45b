"""Mixing sources to target weights with exact block quotas, on DataFrame and SQL functions only.

Each source is a stream of words: its documents in the order of md5(doc_id), a fixed permutation. A source's target
is its weight's share of all words, never above `max_repeat` times its own size (water filling). The stream is read
`target // size` times whole and then up to the remainder, so a source gives exactly round(target) words; at most one
document of a source is taken in part. The words taken are counted in blocks; a multivariate-hypergeometric splitting
tree halves the output shards again and again and deals every source's block quota to the halves, and each shard then
takes its quota of permuted blocks, disjoint from those of the other shards, and shuffles them by a hash.

Empty tables give an empty result. Null or wordless texts have size 0 and are never taken. A null source is a source of
its own, ordered last. Repeated rows are separate documents; rows with equal ids and sizes are interchangeable. Extra
columns of the input, clashing names included, are ignored: only the three named columns are read. Very long texts are
counted whole and drawn into the shard of the block in which they begin. Ties (equal keys) are rows of one doc_id; sizes order them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .words import words


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source key (null apart from every string) and md5 key of each document."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words(F.col(text))).cast("long").alias("size"),
        F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string"))).alias("skey"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("key"),
    ).withColumn("bucket", F.substring("key", 1, 3))


def targets(sources: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """skey, source_size -> and target: water filling over the sources, one row each.

    In the order of max_repeat * size / weight, a source is capped while that ratio is under the level reached by giving
    all words not yet given by weight to it and those after it; the highest level is the final one.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("skey")))
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * float(max_repeat)
    by_ratio = Window.orderBy(cap / F.col("weight"), "skey")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", level).withColumn("top", F.max("level").over(everything))
    return levelled.select("skey", "rank", "weight", "source_size", F.when(cap / F.col("weight") < F.col("level"), cap).otherwise(F.least(cap, F.col("top") * F.col("weight"))).alias("target"))


def _ln_gamma(x: str) -> str:
    """SQL for ln gamma(x), x >= 1: Stirling's series after a shift by 8."""
    z = f"({x} + 8D)"
    shift = " * ".join(f"({x} + {i}D)" for i in range(8))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1D/(12D*{z}) - 1D/(360D*pow({z},3)) + 1D/(1260D*pow({z},5)) - ln({shift}))"


def _ln_choose(n: str, k: str) -> str:
    return f"({_ln_gamma(f'({n} + 1D)')} - {_ln_gamma(f'({k} + 1D)')} - {_ln_gamma(f'({n} - {k} + 1D)')})"


def _bound(value: str, name: str, body: str) -> str:
    """SQL for: let name be value in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _hypergeometric(u: str, total: str, marked: str, drawn: str) -> str:
    """SQL for the number of marked among drawn, by inversion of u over mode +- 10 standard deviations."""
    spread = f"cast(ceil(10D * sqrt(greatest(0D, v.n / v.t * v.k * (1D - v.k / v.t) * (v.t - v.n) / greatest(v.t - 1D, 1D)))) + 2 as bigint)"
    mode = "cast(floor((v.n + 1D) * (v.k + 1D) / (v.t + 2D)) as bigint)"
    low = f"greatest(0L, cast(v.n + v.k - v.t as bigint), {mode} - {spread})"
    high = f"least(cast(v.n as bigint), cast(v.k as bigint), {mode} + {spread})"
    first = f"exp({_ln_choose('v.k', 'r.lo')} + {_ln_choose('(v.t - v.k)', '(v.n - r.lo)')} - {_ln_choose('v.t', 'v.n')})"
    step = "(v.k - i) * (v.n - i) / ((i + 1D) * (v.t - v.k - v.n + i + 1D))"
    walk = (
        f"aggregate(sequence(r.lo, r.hi), named_struct('p', {first}, 'c', 0D, 'x', r.lo), "
        f"(s, i) -> named_struct('p', if(i < r.hi, s.p * {step}, 0D), 'c', s.c + s.p, 'x', if(s.c + s.p < v.u and i < r.hi, i + 1L, s.x)), s -> s.x)"
    )
    inner = _bound(f"named_struct('lo', {low}, 'hi', {high})", "r", walk)
    return _bound(f"named_struct('u', {u}, 't', cast({total} as double), 'k', cast({marked} as double), 'n', cast({drawn} as double))", "v", f"if(v.n <= 0 or v.k <= 0, 0L, {inner})")


def split_tree(quotas: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """One row with q array<long> (block quota by source) -> shard, q: the quota by source of every shard.

    Each level splits a node's blocks into halves: the left half's total is fixed, its parts by source are drawn without
    replacement (multivariate hypergeometric, one conditional hypergeometric draw a source). Sums by source are exact.
    """
    nodes = quotas.select(F.lit(0).alias("shard"), "q")
    level = 1
    while level < shards:
        u = f"(pmod(xxhash64({seed}, {level}, shard, i), 9007199254740992L) + 0.5D) / 9007199254740992D"
        draw = _bound(_hypergeometric(u, "st.t", "q[i]", "st.c"), "x", "named_struct('t', st.t - q[i], 'c', st.c - x, 'o', concat(st.o, array(x)))")
        whole = "aggregate(q, 0L, (a, b) -> a + b)"
        left = f"if(size(q) = 0, cast(array() as array<bigint>), aggregate(sequence(0, size(q) - 1), named_struct('t', {whole}, 'c', {whole} div 2L, 'o', cast(array() as array<bigint>)), (st, i) -> {draw}, st -> st.o))"
        halves = nodes.withColumn("l", F.expr(left)).select("shard", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("q")), F.struct(F.lit(1).alias("side"), F.zip_with("q", "l", lambda a, b: a - b).alias("q")))).alias("h"))
        nodes = halves.select((F.col("shard") * 2 + F.col("h.side")).alias("shard"), F.col("h.q").alias("q"))
        level *= 2
    return nodes


def _planned(rows: DataFrame, weights, max_repeat: int, shards: int, block_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Sized rows -> cells skey, bucket, cell_size, cell_from; and plan skey, source_size, target, words, blocks, upto by source."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    cells = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(cells.withColumn("cell_from", F.coalesce(F.sum("cell_size").over(before), F.lit(0))), "mix-cells")
    plan = written(targets(cells.groupBy("skey").agg(F.sum("cell_size").alias("source_size")), weights, max_repeat), "mix-targets")
    plan = plan.withColumn("words", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("words") / F.lit(block_words)).cast("long"))
    quota = F.transform(F.array_sort(F.collect_list(F.struct("rank", "blocks"))), lambda x: x["blocks"])
    dealt = split_tree(plan.groupBy().agg(quota.alias("q")), shards, seed)
    dealt = dealt.select("shard", F.posexplode("q").alias("i", "n")).withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("shard")))
    dealt = dealt.groupBy((F.col("i") + 1).alias("rank")).agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("upto"))
    return cells, written(plan.join(dealt, "rank", "left").drop("rank", "weight"), "mix-plan")


def shard_quotas(docs: DataFrame, weights=(5, 2, 1), max_repeat: int = 3, shards: int = 16, block_words: int = 4096, seed: int = 7, **columns) -> DataFrame:
    """source, shard, blocks: the quotas that the splitting tree deals."""
    _, plan = _planned(written(sized(docs, **columns), "mix-sizes"), weights, max_repeat, shards, block_words, seed)
    return plan.selectExpr("if(skey <> '1', substring(skey, 2), null) AS source", "posexplode(transform(upto, (u, k) -> u - coalesce(get(upto, k - 1), 0L))) AS (shard, blocks)")


def mix(docs: DataFrame, weights=(5, 2, 1), max_repeat: int = 3, shards: int = 16, block_words: int = 4096, seed: int = 7, **columns) -> DataFrame:
    """Every document with its draws: doc_id, source, size, source_size, target, draws array<struct<epoch, shard, block, turn, words>>.

    A draw is one copy of the document in shard `shard`, at the place `turn` gives among that shard's draws; words < size
    only for the one document of a source at which its last round ends. shards must be a power of two.
    """
    rows = written(sized(docs, **columns), "mix-sizes")
    cells, plan = _planned(rows, weights, max_repeat, shards, block_words, seed)
    # The small side holds 4,096 cells a source; it joins by key, whatever its size.
    cells = cells.join(plan, "skey").drop("cell_size")
    inside = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("pos", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cells, ["skey", "bucket"])
    epochs = F.when((F.col("size") > 0) & (F.col("words") > 0), F.sequence(F.lit(0).cast("long"), F.expr("words div source_size"))).otherwise(F.array().cast("array<bigint>"))
    start = F.col("cell_from") + F.col("pos")

    def draw(epoch: Column) -> Column:
        at = epoch * F.col("source_size") + start
        block = F.floor(at / F.lit(block_words)).cast("long")
        turned = F.pmod(block * F.lit(2654435761) + F.lit(seed), F.greatest(F.col("blocks"), F.lit(1).cast("long")))
        shard = F.size(F.filter("upto", lambda c: c <= turned))
        return F.struct(epoch.alias("epoch"), shard.alias("shard"), block.alias("block"), F.xxhash64(F.lit(seed), epoch, "key").alias("turn"), F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("words") - at)).alias("words"))

    draws = F.filter(F.transform(epochs, draw), lambda d: d["words"] > 0)
    return rows.select("doc_id", "source", "size", "source_size", "target", draws.alias("draws"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: columns of docs, _shard, _turn; a row for each copy drawn, cut after the words taken where a copy is partial."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    name = F.col("doc_id").cast("string")
    if not odd.isEmpty():  # rows without an id of their own get a name by their contents
        whole = F.xxhash64(*docs.columns)
        name = F.concat_ws("#", F.coalesce(name, F.lit("null")), whole, F.row_number().over(Window.partitionBy("doc_id", whole).orderBy("text")))
    named = docs.withColumn("_row", name)
    copies = mix(named.select(F.col("_row").alias("doc_id"), "text", "source"), **options)
    copies = copies.select(F.col("doc_id").alias("_row"), F.explode("draws").alias("_draw"), F.col("size").alias("_size"))
    copies = copies.select("_row", "_size", F.col("_draw.shard").alias("_shard"), F.col("_draw.turn").alias("_turn"), F.col("_draw.words").alias("_words"))
    joined = named.join(copies, "_row")
    lead = F.expr(r"cast(text rlike '^[\\x20\\x09-\\x0D]' as int)")
    rest = F.element_at(F.split("text", r"[\x20\x09-\x0D]+", (F.col("_words") + lead + 1).cast("int")), -1)
    cut = F.when(F.col("_words") < F.col("_size"), F.substring(F.col("text"), F.lit(1), F.char_length("text") - F.char_length(rest))).otherwise(F.col("text"))
    return joined.withColumn("text", cut).select(*docs.columns, "_shard", "_turn")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus in its order: shard after shard, each shuffled; a shard is a run of whole partitions' rows, cut where it is large."""
    return mixed(docs, **options).repartitionByRange("_shard", "_turn").sortWithinPartitions("_shard", "_turn").drop("_shard", "_turn")


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (the sum of what the shards draw), copies, shards (shard:words, comma-joined)."""
    out = mix(docs, **options)
    dealt = F.transform(F.array_sort(F.array_distinct("draws.shard")), lambda s: F.struct(s.alias("shard"), F.aggregate(F.filter("draws", lambda d: d["shard"] == s), F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("words")))
    out = out.withColumn("dealt", dealt)
    taken = F.aggregate("dealt", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    named = F.array_join(F.transform("dealt", lambda d: F.concat_ws(":", d["shard"].cast("string"), d["words"].cast("string"))), ",")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("draws").alias("copies"), named.alias("shards"))


def totals(docs: DataFrame, **options) -> DataFrame:
    """What digest gives, without the shards."""
    return digest(docs, **options).drop("shards")


#: What every document gives in all; the shards themselves are drawn, which SQL cannot say.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS wt FROM s),
l AS (SELECT *, (sum(ss) OVER () - coalesce(sum(3 * ss) OVER (ORDER BY 3 * ss / wt, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(wt) OVER (ORDER BY 3 * ss / wt, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT source, ss::BIGINT AS source_size, CASE WHEN 3 * ss / wt < lv THEN 3 * ss ELSE least(3 * ss, wt * max(lv) OVER ()) END AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS words, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS full_rounds FROM p),
x AS (SELECT *, CASE WHEN source_size > 0 THEN words - full_rounds * source_size ELSE 0 END AS rest FROM q)
SELECT doc_id, size, source_size, target, (full_rounds * size + least(size, greatest(0, rest - pos)))::BIGINT AS taken,
 CASE WHEN size > 0 THEN full_rounds + CASE WHEN rest > pos THEN 1 ELSE 0 END ELSE 0 END::INTEGER AS copies FROM x
"""
