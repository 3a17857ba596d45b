"""Neighbourhoods and participants of the property graph, each leg aggregated before it is joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.staging import staged


def neighbourhood(centre: DataFrame, key: str, legs: dict[str, DataFrame]) -> DataFrame:
    """centre with a sorted array of the distinct values of each leg (columns key, value); null values are left out."""
    out = centre
    for name, leg in legs.items():
        lists = leg.filter(F.col("value").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("value")).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def participants(branches: dict[str, DataFrame], name: str, role: str = "any") -> DataFrame:
    """Rows of the role's branch (an unknown role is any) whose participant contains name, whatever the case; distinct over all."""
    chosen = {role: branches[role]} if role in branches else branches
    parts = [df.filter(F.lower("participant").contains(name.lower())).withColumn("role", F.lit(r)) for r, df in chosen.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def last_rating(ratings: DataFrame, keys: list[str], seq: str, fields: list[str]) -> DataFrame:
    """One edge for each key: the last row's fields win."""
    return ratings.groupBy(*keys).agg(F.max_by(F.struct(*fields), seq).alias("e")).select(*keys, *[F.col(f"e.{f}") for f in fields])


def reached(starts: DataFrame, edges: DataFrame, depth: int, node: str = "node") -> DataFrame:
    """start, node, depth: every vertex within `depth` edges (source, target) of each start, itself at 0, with its least distance.

    A frontier takes one step a round and loses what is known already, so cycles end; it stops early when none is left. Rounds
    are written, so each reads the one before, not all. Edges with a null end lead nowhere; repeated edges count once.
    """
    steps = staged(edges.select("source", "target").dropna().distinct(), "edges")
    frontier = starts.select(F.col(node).alias("start"), F.col(node).alias("node")).dropna().distinct()
    known = frontier = staged(frontier.withColumn("depth", F.lit(0)), "reached")
    for n in range(1, depth + 1):
        ahead = frontier.select("start", F.col("node").alias("source")).join(steps, "source").select("start", F.col("target").alias("node")).distinct()
        frontier = staged(ahead.join(known, ["start", "node"], "left_anti").withColumn("depth", F.lit(n)), "reached")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def issuer_star(edges: DataFrame, issuer: str) -> DataFrame:
    """issuer, issue_id and, for each of the issuer's issues, its series, ratings, trustees and lead managers as sorted distinct arrays."""
    issues = edges.filter((F.col("type") == "ISSUED") & (F.col("source") == issuer)).select(F.col("source").alias("issuer"), F.col("target").alias("issue_id")).distinct()
    mine = edges.join(issues.select("issue_id"), edges["source"] == F.col("issue_id"), "left_semi")
    leg = lambda kind, value: mine.filter(F.col("type") == kind).select(F.col("source").alias("issue_id"), value.alias("value"))
    plain = F.col("target")
    legs = {"series_numbers": leg("HAS_SERIES", plain), "ratings": leg("RATED_BY", F.struct(F.col("target").alias("agency"), "outlook")), "debenture_trustees": leg("HAS_DEBENTURE_TRUSTEE", plain), "lead_managers": leg("HAS_LEAD_MANAGER", plain)}
    return neighbourhood(issues, "issue_id", legs).select("issuer", "issue_id", *legs)
