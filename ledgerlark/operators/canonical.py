"""From series terms to facts, shared terms, chunks, relational rows and graph rows of canonical documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.schema import ISSUE_TERMS, TERMS


def value_of(fact: Column) -> Column:
    return fact["value"]


def pages_of(fact: Column) -> Column:
    return F.coalesce(F.transform(fact["provenance"], lambda p: p["page"]), F.array().cast("array<int>"))


def first_page(pages: Column) -> Column:
    return F.coalesce(F.array_min(pages), F.lit(1))


def merged_provenance(parts: Column) -> Column:
    """Provenance entries in order, one for each document and page."""
    add = lambda seen, p: F.when(F.exists(seen, lambda q: (q["document_id"] == p["document_id"]) & (q["page"] == p["page"])), seen).otherwise(F.concat(seen, F.array(p)))
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1), add)


def fact_line(label: str, fact: Column) -> Column:
    """`Label: value unit`, the unit only where the value does not hold it; null without a value."""
    unit = fact["unit"]
    shown = F.when(unit.isNull() | F.contains(fact["value"], unit), fact["value"]).otherwise(F.concat_ws(" ", fact["value"], unit))
    return F.when(fact["value"].isNotNull(), F.concat(F.lit(f"{label}: "), shown))


def _title(name: str) -> str:
    return name.replace("_", " ").title()


def issues(docs: DataFrame, *fields: str) -> DataFrame:
    """document_id, document_name, document_type, issuer and the issue's fields (all, or those named), one row an issue.

    Named fields leave the others unread, also where documents are made by the same plan.
    """
    some = F.arrays_zip(*[F.col(f"issuer.issues.{f}").alias(f) for f in fields]) if fields else F.col("issuer.issues")
    rows = docs.select("document.*", F.col("issuer.name").alias("issuer"), F.explode(some).alias("issue"))
    return rows.select("document_id", "document_name", "document_type", "document_date", "page_count", "issuer", "issue.*")


def series(docs: DataFrame) -> DataFrame:
    base = issues(docs, "issue_id", "series").select("document_id", "document_name", "document_type", "issuer", "issue_id", F.posexplode("series").alias("series_no", "s"))
    return base.select("document_id", "document_name", "document_type", "issuer", "issue_id", "series_no", "s.*")


def overview_chunks(docs: DataFrame) -> DataFrame:
    """One chunk an issue: name, trustee, managers, and every fact it states; hoisted terms come last."""
    rows = issues(docs, "issue_id", "issue_name", "terms", "debenture_trustee", "lead_managers")
    facts = [fact_line(_title(n), F.col("terms")[n]) for n in ISSUE_TERMS]
    more = F.transform(F.map_entries(F.col("terms.additional_terms")), lambda e: F.concat(F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), e["value"]["value"]))
    head = F.array_compact(F.array(F.concat(F.lit("Issuer: "), "issuer"), F.concat(F.lit("Issue: "), "issue_name"), *facts, F.concat(F.lit("Debenture Trustee: "), "debenture_trustee"), F.concat(F.lit("Lead Managers: "), F.nullif(F.array_join("lead_managers", ", "), F.lit("")))))
    body = F.array_join(F.concat(head, F.coalesce(more, F.array().cast("array<string>"))), "\n")
    return rows.select("document_id", F.lit(0).alias("rank"), F.col("issue_id").alias("order"), F.concat("issue_id", F.lit("_overview")).alias("chunk_id"), F.lit("structured_fact").alias("chunk_type"), body.alias("text"), F.lit(None).cast("string").alias("series_id"), F.lit(None).cast("string").alias("category_id"))


def rating_chunks(docs: DataFrame) -> DataFrame:
    """One chunk a rating, numbered from 1 in the issue."""
    rows = issues(docs, "issue_id", "ratings").select("document_id", "issuer", "issue_id", F.posexplode("ratings").alias("i", "r"))
    body = F.concat_ws("\n", F.concat(F.lit("Issuer: "), "issuer"), F.concat(F.lit("Rating Agency: "), "r.agency"), F.concat(F.lit("Rating: "), "r.rating"), F.concat(F.lit("Outlook: "), "r.outlook"), F.concat(F.lit("Rating Date: "), "r.rating_date"))
    n = F.format_string("%s_rating_%d", F.col("issue_id"), F.col("i") + 1)
    return rows.select("document_id", F.lit(1).alias("rank"), n.alias("order"), n.alias("chunk_id"), F.lit("structured_fact").alias("chunk_type"), body.alias("text"), F.lit(None).cast("string").alias("series_id"), F.lit(None).cast("string").alias("category_id"))


def series_chunks(docs: DataFrame) -> DataFrame:
    """One chunk for each series and category; one for the series where it has no category."""
    rows = series(docs).withColumn("c", F.explode_outer("categories"))
    facts = [fact_line(_title(n), F.col("terms")[n]) for n in TERMS]
    own = F.transform(F.map_entries("c.terms"), lambda e: F.concat(F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), e["value"]["value"]))
    lines = F.concat(F.array_compact(F.array(F.concat(F.lit("Issuer: "), "issuer"), F.concat(F.lit("Series: "), "series_id"), F.concat(F.lit("Category: "), F.coalesce("c.category_name", text.category_name(F.col("c.category_id")))), *facts)), F.coalesce(own, F.array().cast("array<string>")))
    name = F.concat_ws("_", "issue_id", F.concat(F.lit("series_"), "series_id"), F.concat(F.lit("cat_"), F.col("c.category_id")))
    return rows.select("document_id", F.lit(2).alias("rank"), F.format_string("%06d_%s", F.col("series_no"), F.coalesce("c.category_id", F.lit(""))).alias("order"), name.alias("chunk_id"), F.lit("structured_fact").alias("chunk_type"), F.array_join(lines, "\n").alias("text"), "series_id", F.col("c.category_id").alias("category_id"))


def fact_chunks(docs: DataFrame) -> DataFrame:
    """Overview, ratings and series, to be ordered by document_id, rank and order. They have provenance but no pages of their own."""
    return overview_chunks(docs).unionByName(rating_chunks(docs)).unionByName(series_chunks(docs))


def payload(chunks: DataFrame) -> DataFrame:
    """What the vector store keeps of a chunk: section is the first and subsection the last of its path, empty without one."""
    path = F.coalesce("section_path", F.array().cast("array<string>"))
    at = lambda i: F.coalesce(F.try_element_at(path, F.lit(i)), F.lit(""))
    kept = chunks.filter(F.trim("text") != "")
    return kept.withColumn("point_id", text.point_id(F.col("chunk_id"))).withColumn("section", at(1)).withColumn("subsection", at(-1)).withColumn("section_path", F.array_join(path, " > "))


def _places(name: str) -> Column:
    """array<struct<page_number, source_field>> of a term; null without the term."""
    fact = F.col(f"terms.{name}")
    return F.when(fact.isNotNull(), F.transform(pages_of(fact), lambda p: F.struct(p.alias("page_number"), F.lit(name).alias("source_field"))))


def relational(docs: DataFrame) -> dict[str, DataFrame]:
    """The relational rows by table, with natural keys."""
    i, s = issues(docs), series(docs)
    term = lambda c, n: F.col(f"{c}.{n}.value").alias(n)
    categories = s.select("document_name", "issue_id", "series_id", F.explode("categories").alias("c")).withColumn("category_code", F.explode(text.category_parts(F.col("c.category_id"))))
    number = lambda key, name, kind: F.try_element_at("c.terms", F.lit(key))["value"].try_cast(kind).alias(name)
    pages = [_places(n) for n in TERMS]
    own = F.transform("provenance", lambda p: F.struct(p["page"].alias("page_number"), F.lit("series").alias("source_field")))
    return {
        "issuers": i.select(F.col("issuer").alias("issuer_name")).distinct(),
        "documents": i.select(F.col("issuer").alias("issuer_name"), "document_name", "document_type", F.col("document_id").alias("document_identifier"), "document_date", "page_count").distinct(),
        "issues": i.select("document_name", F.col("issue_id").alias("issue_identifier"), "issue_name", "debenture_trustee", *[term("terms", n) for n in ISSUE_TERMS]),
        "ratings": i.select("issue_id", F.explode("ratings").alias("r")).select("issue_id", "r.agency", "r.rating", "r.outlook", "r.instrument", "r.rating_date").dropDuplicates(["issue_id", "agency", "rating"]),
        "lead_managers": i.select("issue_id", F.explode("lead_managers").alias("name")).distinct(),
        "series": s.select("issue_id", F.col("series_id").alias("series_code"), F.col("series_name").alias("series_identifier"), *[term("terms", n) for n in TERMS if n != "face_value"], F.col("terms.face_value.value").try_cast("decimal(18,2)").alias("face_value_inr")),
        "investor_categories": categories.select("category_code", F.concat(F.lit("Category "), "category_code").alias("category_name")).distinct(),
        "series_category_terms": categories.select("issue_id", F.col("series_id").alias("series_code"), "category_code", number("issue_price", "issue_price_inr", "decimal(18,2)"), number("coupon", "coupon_percent", "decimal(10,4)"), number("effective_yield", "effective_yield_percent", "decimal(10,4)"), number("maturity_amount", "maturity_amount_inr", "decimal(18,2)")),
        "series_provenance": s.select("issue_id", F.col("series_id").alias("series_code"), F.explode(F.flatten(F.array_compact(F.array(own, *pages)))).alias("p")).select("issue_id", "series_code", "p.page_number", "p.source_field").distinct(),
    }


def property_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vertices (label, id) and edges (source, type, target, outlook); participants are one vertex whatever the document."""
    i = issues(docs, "issue_id", "debenture_trustee", "lead_managers", "ratings", "series")
    none = F.lit(None)
    edge = lambda source, kind, target, outlook=none, n=none: F.struct(source.alias("source"), F.lit(kind).alias("type"), target.alias("target"), outlook.cast("string").alias("outlook"), n.cast("int").alias("n"))
    own = F.col("issue_id")
    all_ = F.concat(
        F.array(edge(F.col("issuer"), "ISSUED", own), edge(own, "HAS_DEBENTURE_TRUSTEE", F.col("debenture_trustee"))),
        *[F.coalesce(x, F.array()) for x in (
            F.transform("lead_managers", lambda m: edge(own, "HAS_LEAD_MANAGER", m)), F.transform("ratings", lambda r, n: edge(own, "RATED_BY", r["agency"], r["outlook"], n)), F.transform("series", lambda s: edge(own, "HAS_SERIES", s["series_id"])),
        )],
    )
    # one pass over the documents: of an issue's ratings by one agency the last gives the outlook, of all others equal edges are one
    found = i.select(F.explode(all_).alias("e")).select("e.*").filter("source is not null AND target is not null")
    edges = found.groupBy("source", "type", "target").agg(F.max_by("outlook", "n").alias("outlook"))
    label = {"ISSUED": "Issue", "HAS_DEBENTURE_TRUSTEE": "DebentureTrustee", "HAS_LEAD_MANAGER": "LeadManager", "RATED_BY": "RatingAgency", "HAS_SERIES": "Series"}
    kinds = F.create_map(*[F.lit(x) for p in label.items() for x in p])
    vertices = edges.select(F.element_at(kinds, F.col("type")).alias("label"), F.col("target").alias("id")).union(i.select(F.lit("Issuer"), "issuer")).distinct()
    return vertices, edges


def category_ids(maps: list[Column]) -> Column:
    """The categories that any of the maps by category names, in the order of their text."""
    none = F.array().cast("array<string>")
    keys = [F.coalesce(F.map_keys(m), none) for m in maps]
    return F.array_sort(F.array_distinct(F.concat(*keys)))


def load_summary(docs: DataFrame) -> DataFrame:
    """One row a document: how many issues, series, ratings, lead managers and chunks of each kind it brings, and how many chunks are blank and skipped."""
    total = lambda name: F.aggregate("issuer.issues", F.lit(0), lambda n, i: n + F.greatest(F.coalesce(F.size(i[name]), F.lit(0)), F.lit(0)))
    chunks = F.coalesce("chunks", F.array().cast(docs.schema["chunks"].dataType))
    blank = lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) == ""
    of = lambda kind: F.size(F.filter(chunks, lambda c: (c["chunk_type"] == kind) & ~blank(c)))
    return docs.select(
        "document.document_id", F.size("issuer.issues").alias("issues"), total("series").alias("series"), total("ratings").alias("ratings"), total("lead_managers").alias("lead_managers"),
        of("structured_fact").alias("structured_facts"), of("prose").alias("prose"), F.size(F.filter(chunks, blank)).alias("skipped"),
    )
