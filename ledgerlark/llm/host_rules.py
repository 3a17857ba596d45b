"""Quality rules with host-level verdicts, on DataFrame and SQL functions only.

Per document: the counts of the rules and the rules' failures. Per host: failures of each rule, their rate shrunk by a
beta prior fitted to all hosts (method of moments, weighted by documents). A host whose shrunk rate of any rule passes
`max_rate` is rejected, and all its documents with it; the verdicts are joined back.

Null or wordless texts have no words and fail the length rule. A null host belongs to no host: it takes no part in the
rates and is never rejected. Empty tables give an empty result; repeated rows count as often as they occur; only the
named columns are read, so extra columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import words

RULES = ("short", "repeats", "symbols", "dup_lines")
#: Up to so many hosts, verdicts are broadcast (some 60 bytes each); beyond, a salted join.
BROADCAST_HOSTS, SALT = 100_000, 64


def _repeat_words(hashes: str) -> Column:
    """Words in 3-word windows that occur twice or more, by the sorted window hashes and their places.

    Neighbours in the sorted list with one hash mark both places; a place covers up to three words, less where the next
    marked place follows sooner.
    """
    pairs = f"sort_array(transform({hashes}, (h, i) -> named_struct('h', h, 'i', i)))"
    marked = "transform(filter(s, (x, k) -> x.h <=> get(s, k + 1).h or x.h <=> get(s, k - 1).h), x -> x.i)"
    places = f"sort_array(transform(array({pairs}), s -> {marked})[0])"
    covered = "aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (t, x) -> t + x)"
    return F.expr(f"if(size({hashes}) < 2 or size(array_distinct({hashes})) = size({hashes}), 0L, transform(array({places}), p -> {covered})[0])")


def rule_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and a boolean for each of RULES."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), t.alias("t"))
    # The word windows are hashed from the words in place; the arrays live for one row only.
    base = base.withColumn("v", words(F.col("t")))
    base = base.withColumn("g", F.expr("if(size(v) < 3, cast(array() as array<bigint>), transform(sequence(0, size(v) - 3), i -> xxhash64(v[i], v[i + 1], v[i + 2])))"))
    lines = r"filter(split(t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    base = base.select(
        "doc_id", "host", F.size("v").cast("long").alias("n_words"),
        F.char_length(F.array_join("v", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.expr(f"transform(array({lines}), l -> cast(size(l) - size(array_distinct(l)) as bigint))[0]").alias("n_dup_lines"),
        F.expr(f"size({lines})").cast("long").alias("n_lines"),
        _repeat_words("g").alias("n_repeat_words"),
    )
    return base.select(
        "*", (F.col("n_words") < 50).alias("short"), (100 * F.col("n_repeat_words") > 50 * F.col("n_words")).alias("repeats"),
        (10 * F.col("n_symbols") > F.col("word_chars")).alias("symbols"), (100 * F.col("n_dup_lines") > 50 * F.col("n_lines")).alias("dup_lines"),
    )


def host_verdicts(counted: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, n_docs, <rule>_rate (shrunk) for each rule, rejected."""
    hosts = written(counted.filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES]), "host-counts")
    total = hosts.agg(F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("hosts"), *[F.sum(r).alias(r) for r in RULES]).first()
    n = total["n"] or 0
    means = {r: (total[r] + 0.5) / (n + 1) if n else 0.5 for r in RULES}
    spread = hosts.agg(*[(F.sum(F.col("n_docs") * (F.col(r) / F.col("n_docs") - means[r]) ** 2) / max(n, 1)).alias(r) for r in RULES]).first()
    shrunk = []
    for r in RULES:
        m, share = means[r], (total["hosts"] or 1) / max(n, 1)
        variance = max((spread[r] or 0.0) - m * (1 - m) * share, 1e-9)  # less what chance adds
        strength = min(max(m * (1 - m) / variance - 1, 2.0), 1000.0)
        shrunk.append(((F.col(r) + m * strength) / (F.col("n_docs") + strength)).alias(f"{r}_rate"))
    rated = hosts.select("host", "n_docs", *shrunk)
    rejected = F.greatest(*[F.col(f"{r}_rate") for r in RULES]) > max_rate
    return rated.withColumn("rejected", rejected)


def judged(docs: DataFrame, max_rate: float = 0.5, **columns) -> DataFrame:
    """rule_counts with the host's verdict: base_failed, host_rejected, kept."""
    counted = written(rule_counts(docs, **columns), "rule-counts")
    hosts = written(host_verdicts(counted, max_rate).select("host", F.col("rejected").alias("host_rejected")), "host-verdicts")
    if hosts.count() <= BROADCAST_HOSTS:
        joined = counted.join(F.broadcast(hosts), "host", "left")
    else:
        salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = counted.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    base_failed = F.col("short") | F.col("repeats")
    return joined.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~F.col("host_rejected"))


def digest(docs: DataFrame, **options) -> DataFrame:
    return judged(docs, **options).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
b AS (SELECT d.rid, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r ON r.rid = d.rid LEFT JOIN l ON l.rid = d.rid),
f AS (SELECT *, (n_words < 50)::INT AS f1, (100 * n_repeat_words > 50 * n_words)::INT AS f2, (10 * n_symbols > word_chars)::INT AS f3, (100 * n_dup_lines > 50 * n_lines)::INT AS f4 FROM b),
h AS (SELECT source, k, count(*)::DOUBLE AS n, sum(v)::DOUBLE AS f FROM (SELECT source, unnest([1, 2, 3, 4]) AS k, unnest([f1, f2, f3, f4]) AS v FROM f WHERE source IS NOT NULL) GROUP BY source, k),
m AS (SELECT k, sum(n) AS n, count(*) AS hosts, (sum(f) + 0.5) / (sum(n) + 1) AS m FROM h GROUP BY k),
s AS (SELECT h.k, m.m, m.n, m.hosts, sum(h.n * (h.f / h.n - m.m) * (h.f / h.n - m.m)) / m.n AS v FROM h JOIN m ON h.k = m.k GROUP BY h.k, m.m, m.n, m.hosts),
a AS (SELECT k, m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * hosts / n, 1e-9) - 1, 2.0), 1000.0) AS z FROM s),
x AS (SELECT source, max((f + m * z) / (n + z)) > 0.5 AS bad FROM h JOIN a ON h.k = a.k GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 + f2) > 0 AS base_failed, (f1 + f2) = 0 AND NOT coalesce(x.bad, false) AS kept FROM f LEFT JOIN x ON x.source = f.source
"""
