"""Typed read-only look-ups over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sides up to this many rows are broadcast in star joins; larger ones are left to the optimizer.
SMALL = 100_000


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df, broadcast if a bounded count shows that it is small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def matching(df: DataFrame, equal: dict[str, object] | None = None, like: dict[str, str] | None = None, collation: str | None = None) -> DataFrame:
    """AND of the constraints whose value is truthy: equality, and LIKE '%value%' whose wildcards stay live.

    Text is compared exactly, which scans can be told; with a collation such as UTF8_LCASE by that, after the scan.
    """
    side = lambda name, value: F.collate(F.col(name), collation) if collation and isinstance(value, str) else F.col(name)
    for name, value in (equal or {}).items():
        if value:
            df = df.filter(side(name, value) == F.lit(value))
    for name, value in (like or {}).items():
        if value:
            df = df.filter(side(name, value).like(f"%{value}%"))
    return df


def among(df: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """Rows whose value is one of the ids (one column of that name), as a semi join: the list may be of any length."""
    return df.join(ids.select(name).distinct(), name, "left_semi")


def star(fact: DataFrame, inner: list[tuple[DataFrame, Column]], left: list[tuple[DataFrame, Column]] = ()) -> DataFrame:
    """fact with its parents (inner) and optional details (left)."""
    for side, on in inner:
        fact = fact.join(side, on, "inner")
    for side, on in left:
        fact = fact.join(side, on, "left")
    return fact


def first_page(rows: DataFrame, provenance: DataFrame, key: str, page: str) -> DataFrame:
    """rows with the least page of their key, aggregated before the join."""
    return rows.join(provenance.groupBy(key).agg(F.min(page).alias("first_page")), key, "left")


def attached(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """parents with an ordered list of the structs of their children; an empty list without any."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def capped(df: DataFrame, order: list[str], cap: int = 200) -> DataFrame:
    """The first cap rows, nulls first."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(cap)


def sentence(parts: dict[str, Column], tail: str = ".") -> Column:
    """`label value` parts joined by commas, null ones left out."""
    return F.concat(F.concat_ws(", ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k} "), v.cast("string"))) for k, v in parts.items()]), F.lit(tail))


#: Columns of the two look-ups, in the order in which the tools return them.
TERM_COLUMNS = [
    "series_id", "issuer", "document_name", "issue_name", "series_code", "tenor", "frequency", "coupon_type", "face_value_inr", "mode_of_interest_payment", "maturity_redemption",
    "nature_of_indebtedness", "put_call_option", "category_code", "issue_price_inr", "coupon_percent", "effective_yield_percent", "maturity_amount_inr",
]
ISSUE_COLUMNS = [
    "issue_id", "issuer", "document_name", "issue_name", "issue_size", "issue_open_date", "issue_close_date", "allotment_date", "listing", "exchange", "security_type", "shelf_limit",
    "green_shoe_option", "security_cover", "debenture_trustee",
]
#: The names of the relational tables for those of the tools.
TERM_NAMES = {"frequency": "frequency_of_interest_payment"}
ISSUE_NAMES = {"issue_id": "issue_identifier", "issue_size": "base_issue_size", "exchange": "listing_exchange"}


def _named(rows: DataFrame, columns: list[str], names: dict[str, str], more: list[str] = ()) -> DataFrame:
    """rows by the tools' names: the column itself, the one it is stored as, or null where the table has neither."""
    held = set(rows.columns)
    one = lambda c: F.col(c) if c in held else F.col(names[c]).alias(c) if names.get(c) in held else F.lit(None).cast("string").alias(c)
    return rows.select(*map(one, columns), *[m for m in more if m not in columns])


def _with_documents(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    return rows.join(tables["documents"].select(F.col("issuer_name").alias("issuer"), "document_name").distinct(), "document_name")


def bond_terms(tables: dict[str, DataFrame], issuer: str | None = None, document_name: str | None = None, series_code: str | None = None, category_code: str | None = None, tenor: str | None = None, nature_of_indebtedness: str | None = None, collation: str | None = None) -> DataFrame:
    """TERM_COLUMNS, first_page and section of series and their categories, from the relational tables (canonical.relational).

    series_id is issue:series. A series without categories has one row; a page is the least of its provenance, null without any.
    """
    issues = tables["issues"].select("document_name", F.col("issue_identifier").alias("issue_id"), "issue_name")
    rows = _with_documents(tables["series"].join(issues, "issue_id"), tables).join(tables["series_category_terms"], ["issue_id", "series_code"], "left")
    rows = matching(rows, {"issuer": issuer, "document_name": document_name, "series_code": series_code, "category_code": category_code, "nature_of_indebtedness": nature_of_indebtedness}, {"tenor": tenor}, collation)
    pages = tables["series_provenance"].groupBy("issue_id", "series_code").agg(F.min("page_number").alias("first_page"))
    rows = rows.join(pages, ["issue_id", "series_code"], "left").withColumn("series_id", F.concat_ws(":", "issue_id", "series_code"))
    section = F.concat_ws(" / ", F.concat(F.lit("Series "), "series_code"), F.concat(F.lit("Category "), F.nullif("category_code", F.lit(""))))
    return _named(rows.withColumn("section", section), TERM_COLUMNS, TERM_NAMES, ["first_page", "section"])


def issue_facts(tables: dict[str, DataFrame], issuer: str | None = None, document_name: str | None = None, collation: str | None = None) -> DataFrame:
    """ISSUE_COLUMNS, ratings and lead_managers of every issue; both lists are empty where the issue has none."""
    rows = matching(_with_documents(tables["issues"], tables), {"issuer": issuer, "document_name": document_name}, collation=collation)
    rows = _named(rows, ISSUE_COLUMNS, ISSUE_NAMES)
    rows = attached(rows, tables["ratings"], "issue_id", ["agency", "rating", "outlook", "instrument", "rating_date"], "ratings")
    rows = attached(rows, tables["lead_managers"], "issue_id", ["name"], "lead_managers")
    return rows.withColumn("lead_managers", F.transform("lead_managers", lambda m: m["name"])).select(*ISSUE_COLUMNS, "ratings", "lead_managers")


def known_issues(tables: dict[str, DataFrame]) -> DataFrame:
    """issue_id, issuer, document_name, issue_name, debenture_trustee of every issue whose document is known."""
    return _named(_with_documents(tables["issues"], tables), ["issue_id", "issuer", "document_name", "issue_name", "debenture_trustee"], ISSUE_NAMES)


def participations(tables: dict[str, DataFrame], issues: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """issue_id, issuer, document_name, issue_name, participant_name, participant_role: trustees, lead managers and rating agencies.

    issues: known_issues, where they are at hand; names (participant_name): those alone, left out before anything is joined.
    """
    issues = known_issues(tables) if issues is None else issues
    of = lambda rows: rows if names is None else rows.join(small(names), "participant_name", "left_semi")
    role = lambda rows, kind: rows.withColumn("participant_role", F.lit(kind))
    said = lambda rows, name: of(rows.select("issue_id", F.col(name).alias("participant_name")).filter("participant_name <> ''")).distinct()
    places = issues.drop("debenture_trustee")
    # the trustees of an issue are all that its rows name; they stand in these rows, so nothing is joined
    trustees = F.collect_set("debenture_trustee").over(Window.partitionBy("issue_id"))
    every = issues.filter("issue_id IS NOT NULL").withColumn("_t", trustees).withColumn("participant_name", F.explode("_t")).filter("participant_name <> ''")
    every = role(of(every).select(*places.columns, "participant_name"), "DebentureTrustee")
    every = every.unionByName(role(places.join(said(tables["lead_managers"], "name"), "issue_id"), "LeadManager"))
    return every.unionByName(role(places.join(said(tables["ratings"], "agency"), "issue_id"), "RatingAgency"))
