"""Nested documents (schema.DOCUMENT) from series terms and pages: series, shared terms, issue facts, ratings, parties, chunks.

Every step works on each document by itself, keyed by document_id; nothing goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark import schema
from ledgerlark.functions import extract, names, text
from ledgerlark.operators import canonical, chunking, entities
from ledgerlark.operators.staging import sorted_groups, staged

KEY = ("document_id",)
UNKNOWN = "UNKNOWN"
# The terms' fields in tables and in documents, and their units.
FIELDS = {
    "tenor": "tenor", "frequency": "frequency_of_interest_payment", "minimum_application": "minimum_application", "face_value_inr": "face_value", "mode_of_interest_payment": "mode_of_interest_payment",
    "maturity_redemption": "maturity_redemption", "nature_of_indebtedness": "nature_of_indebtedness", "put_call_option": "put_call_option",
}
UNITS = {"face_value_inr": "INR", "issue_price": "INR", "maturity_amount": "INR", "coupon": "percent", "effective_yield": "percent"}
#: Terms that go to the issue if all series state the same; the first becomes the issue's security type.
SHARED = ["nature_of_indebtedness", "minimum_application", "mode_of_interest_payment", "maturity_redemption", "put_call_option"]


def places(document: Column, pages: Column, source: Column | None = None) -> Column:
    source = F.lit(None).cast("string") if source is None else source
    return F.transform(pages, lambda p: F.struct(document.alias("document_id"), p.cast("int").alias("page"), source.alias("source_text"), F.lit(None).cast("array<double>").alias("bbox")))


def fact(value: Column, document: Column, page: Column, unit: Column | None = None, raw: Column | None = None) -> Column:
    """A fact with its page; null without a value."""
    unit, raw = F.lit(None).cast("string") if unit is None else unit, value if raw is None else raw
    return F.when(value.isNotNull(), F.struct(value.cast("string").alias("value"), unit.alias("unit"), raw.cast("string").alias("raw_value"), places(document, F.array(page)).alias("provenance"))).cast(schema.FACT)


def _sorted(df: DataFrame) -> DataFrame:
    """One side of a join by documents: merged, never broadcast. Estimates see the size of files, not that of the many documents in them."""
    return df.hint("merge")


def _by(name: str):
    return lambda x, y: F.when(x[name] < y[name], -1).when(x[name] > y[name], 1).otherwise(0)


def series(terms: DataFrame) -> DataFrame:
    """Rows of tables.series_terms -> document_id, series: one list a document, in the order of the series' text.

    Facts stand on the first page of their series; a coupon type is derived from the frequency. Categories are in the order
    of their text. Fields that documents do not know are left out.
    """
    sorted_groups(terms.sparkSession)
    # the window's order is that of all groups below, which therefore take their rows as they come
    own = Window.partitionBy("document_id", "series_id").orderBy("category").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = terms.withColumn("page", F.min(canonical.first_page(F.col("pages"))).over(own))
    units = F.create_map(*[F.lit(x) for p in UNITS.items() for x in p])
    rows = rows.withColumn("_value", F.coalesce(F.col("value_num").cast("string"), "value_text")).withColumn("_unit", units[F.col("field")]).filter("_value IS NOT NULL")
    raw = F.when(F.col("_unit") == "percent", F.concat("_value", F.lit("%"))).otherwise(F.col("_value"))
    facts = rows.withColumn("_fact", F.struct("field", fact(F.col("_value"), F.col("document_id"), F.col("page"), F.col("_unit"), raw).alias("fact")))
    per = facts.groupBy("document_id", "series_id", "category").agg(F.map_from_entries(F.collect_list("_fact")).alias("terms"), F.flatten(F.collect_list("pages")).alias("pages"), F.min("page").alias("page"))
    bare = F.col("category").isNull()
    one = F.struct(F.col("category").alias("category_id"), text.category_name(F.col("category")).alias("category_name"), "terms")
    per = per.withColumn("_own", F.when(bare, F.col("terms"))).withColumn("_one", F.when(~bare, one)).sortWithinPartitions("document_id", "series_id", "category")
    rows = per.groupBy("document_id", "series_id").agg(
        F.first("_own", ignorenulls=True).alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"), F.min("page").alias("page"),
        F.array_sort(F.collect_list("_one"), _by("category_id")).alias("l"),
    )
    by_name = {new: F.col("m")[old] for old, new in FIELDS.items()}
    frequency = by_name["frequency_of_interest_payment"]
    by_name["coupon_type"] = fact(text.coupon_type(frequency["value"]), F.col("document_id"), F.col("page"), raw=frequency["value"])
    known = [by_name.get(n, F.lit(None).cast(schema.FACT)).alias(n) for n in schema.TERMS]
    terms_ = F.struct(*known, F.create_map().cast(f"map<string,{schema.FACT}>").alias("additional_terms"))
    one = F.struct(F.col("series_id"), F.concat(F.lit("Series "), "series_id").alias("series_name"), terms_.alias("terms"), F.col("l").alias("categories"), places(F.col("document_id"), F.col("pages")).alias("provenance"))
    listed = rows.select("document_id", one.alias("s")).sortWithinPartitions("document_id").groupBy("document_id").agg(F.collect_list("s").alias("series"))
    return listed.withColumn("series", F.array_sort("series", _by("series_id")))


def _term(name: str):
    return lambda s: s["terms"][name]


def shared(rows: DataFrame) -> DataFrame:
    """document_id, series -> and shared map<string,fact>: SHARED terms that all series state alike, taken off the series.

    The provenance is that of all series, each page once.
    """
    merged = {}
    for name in SHARED:
        facts = F.transform("series", _term(name))
        alike = F.forall(facts, lambda f: f.isNotNull()) & (F.size(F.array_distinct(F.transform(facts, lambda f: f["value"]))) == 1)
        first = F.get(facts, F.lit(0))
        all_pages = canonical.merged_provenance(F.flatten(F.transform(facts, lambda f: f["provenance"])))
        one = F.struct(first["value"].alias("value"), first["unit"].alias("unit"), first["raw_value"].alias("raw_value"), all_pages.alias("provenance"))
        merged[f"_{name}"] = F.when(alike, one).cast(schema.FACT)
    rows = rows.withColumns(merged)
    own = lambda s, n: F.when(F.col(f"_{n}").isNull(), s["terms"][n]) if n in SHARED else s["terms"][n]
    rest = lambda s: F.struct(*[own(s, n).alias(n) for n in [*schema.TERMS, "additional_terms"]])
    bare = F.transform("series", lambda s: F.struct(*[(rest(s) if n == "terms" else s[n]).alias(n) for n in ("series_id", "series_name", "terms", "categories", "provenance")]))
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"_{n}").alias("value")) for n in SHARED]), lambda p: p["value"].isNotNull())
    return rows.select("document_id", bare.alias("series"), F.map_from_entries(pairs).alias("shared"))


def domain(pages: DataFrame) -> DataFrame:
    """Pages document_id, page, text -> what a document's text says: one row a document with facts, parties and ratings.

    Windows, aliases and groups are read by many steps below; each is written once, or every step would plan and run them again.
    """
    windows = staged(chunking.page_windows(pages, "document_id", "page", "text"), "domain-windows")
    known = staged(entities.alias_map(windows, "chunk_id", by=KEY), "domain-aliases")
    groups = staged(entities.grouped(entities.renamed(entities.mentions(windows, by=KEY), known, KEY), by=KEY), "domain-groups")
    kinds = {"issuer": "Issuer", "base_issue_size": "Base Issue Size", "security_cover": "Security Cover", "trustee": "Debenture Trustee"}
    found = entities.canonicals(groups, kinds, KEY, {"lead_managers": "Lead Manager"})
    page = lambda name: F.array_min(F.transform(f"{name}.mentions", lambda m: m["start_page"])).alias(f"{name}_page")
    managers = F.when(F.size("lead_managers") > 0, F.array_sort("lead_managers")).alias("lead_managers")
    found = found.select("document_id", *[c for n in kinds for c in (F.col(f"{n}.value").alias(n), page(n))], managers)
    out = pages.groupBy("document_id").agg(F.max("page").cast("int").alias("page_count")).join(_sorted(found), "document_id", "left")
    flat = pages.withColumn("t", text.collapsed(F.col("text")))
    t = F.col("t")
    stated = {"open_date": extract.open_date(t), "close_date": extract.close_date(t), "document_date": extract.document_date(t), "issue_name": extract.issue_name(t), "listing": extract.listing(t), "shelf_limit": extract.shelf_limit(t), "green_shoe": extract.green_shoe_option(t)}
    facts = entities.first_over_pages(flat, ["document_id"], "page", stated)
    # no text without these words holds a rating letter
    letters = flat.filter(F.lower("t").contains("letter dated")).select("document_id", "page", F.posexplode(names.rating_letters_in("t")).alias("i", "r")).select("document_id", "page", F.struct("page", "i").alias("seq"), "r.*")
    letters = letters.withColumn("value", F.col("agency"))
    letters = entities.renamed(letters, known, KEY).withColumn("agency", F.col("value"))
    kept = entities.ratings(letters, KEY)
    source = letters.withColumn("agency_key", text.entity_key(F.col("agency"))).groupBy("document_id", "agency_key", "rating").agg(F.min_by("source_text", "seq").alias("source_text"), F.min("seq").alias("seq"))
    kept = kept.withColumn("agency_key", text.entity_key(F.col("agency"))).join(_sorted(source), ["document_id", "agency_key", "rating"])
    rating = F.struct("seq", F.struct("agency", "rating", "outlook", F.lit("NCD").alias("instrument"), "rating_date", places(F.col("document_id"), F.col("pages"), F.col("source_text")).alias("provenance")).alias("r"))
    ratings = kept.select("document_id", rating.alias("x")).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("ratings"))
    return out.join(_sorted(facts), "document_id", "left").join(_sorted(ratings), "document_id", "left")


def prose_chunks(chunks: DataFrame) -> DataFrame:
    """Rows of chunking.chunks_of_sections -> document_id and chunk records of type prose, on their first page."""
    one = F.struct("chunk_id", F.lit("prose").alias("chunk_type"), "text", "start_page", "end_page", F.col("path").alias("section_path"), F.lit(None).alias("series_id"), F.lit(None).alias("category_id"), places(F.col("document"), F.array("start_page")).alias("provenance"))
    return chunks.select(F.col("document").alias("document_id"), one.cast(schema.CHUNK).alias("chunk"))


def documents(terms: DataFrame, pages: DataFrame, prose: DataFrame | None = None) -> DataFrame:
    """Nested documents from rows of tables.series_terms and pages document_id, page, text.

    prose: chunks of sections outside the tables. A document without series gives none (see without_series); one whose
    text names no issuer has the issuer UNKNOWN. Facts come first among the chunks, in the order overview, ratings, series.
    """
    rows = shared(series(terms)).join(_sorted(domain(pages)), "document_id", "left")
    d = F.col("document_id")
    stated = lambda value, page: fact(F.col(value), d, F.col(page))
    issue_terms = {
        "issue_open_date": stated("open_date", "open_date_page"), "issue_close_date": stated("close_date", "close_date_page"), "base_issue_size": stated("base_issue_size", "base_issue_size_page"),
        "shelf_limit": stated("shelf_limit", "shelf_limit_page"), "green_shoe_option": stated("green_shoe", "green_shoe_page"), "security_cover": stated("security_cover", "security_cover_page"),
        "listing_exchange": fact(F.col("listing.exchange"), d, F.col("listing_page")), "security_type": F.try_element_at("shared", F.lit("nature_of_indebtedness")),
    }
    known = [issue_terms.get(n, F.lit(None).cast(schema.FACT)).alias(n) for n in schema.ISSUE_TERMS]
    more = F.map_filter("shared", lambda k, v: k != "nature_of_indebtedness")
    issue = F.struct(
        F.concat(d, F.lit("_issue_1")).alias("issue_id"), F.col("issue_name"), F.struct(*known, more.alias("additional_terms")).alias("terms"), F.col("trustee").alias("debenture_trustee"),
        F.coalesce("lead_managers", F.array().cast("array<string>")).alias("lead_managers"), F.coalesce("ratings", F.array().cast(f"array<{schema.RATING}>")).alias("ratings"), "series",
    )
    document = F.struct(d.alias("document_id"), d.alias("document_name"), F.lit("Bond/NCD Prospectus").alias("document_type"), F.col("document_date"), F.col("page_count"))
    issuer = F.struct(F.concat(d, F.lit("_issuer")).alias("issuer_id"), F.coalesce("issuer", F.lit(UNKNOWN)).alias("name"), F.array(issue.cast(schema.ISSUE)).alias("issues"))
    out = staged(rows.select(document.alias("document"), issuer.alias("issuer")), "documents-bare")  # the chunks are made of it
    made = canonical.fact_chunks(out)
    none = F.lit(None)
    chunk = F.struct("chunk_id", "chunk_type", "text", none.alias("start_page"), none.alias("end_page"), none.alias("section_path"), "series_id", "category_id", none.alias("provenance")).cast(schema.CHUNK)
    listed = made.select("document_id", F.struct("rank", F.col("order").alias("at"), chunk.alias("chunk")).alias("x"))
    if prose is not None:
        listed = listed.unionByName(prose.select("document_id", F.struct(F.lit(3).alias("rank"), F.col("chunk.chunk_id").alias("at"), "chunk").alias("x")))
    listed = listed.groupBy("document_id").agg(F.collect_list("x").alias("l"))
    before = lambda x, y: F.when((x["rank"] < y["rank"]) | ((x["rank"] == y["rank"]) & (x["at"] < y["at"])), -1).when((x["rank"] == y["rank"]) & (x["at"] == y["at"]), 0).otherwise(1)
    listed = listed.select("document_id", F.transform(F.array_sort("l", before), lambda x: x["chunk"]).alias("chunks"))
    return out.join(_sorted(listed), F.col("document.document_id") == F.col("document_id")).select("document", "issuer", "chunks")


def without_series(terms: DataFrame, pages: DataFrame) -> DataFrame:
    """Ids of documents from whose tables no series came: they have no nested document."""
    return pages.select("document_id").distinct().join(_sorted(series(terms).select("document_id")), "document_id", "left_anti")
