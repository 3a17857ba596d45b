"""Incremental loading: a folder of canonical documents as a stream whose batches merge into the tables (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlark import schema
from ledgerlark.operators import canonical, load, snapshots

KEYS = {
    "issuers": ["issuer_name"], "documents": ["issuer_name", "document_name"], "issues": ["document_name", "issue_identifier"], "ratings": ["issue_id", "agency", "rating"], "lead_managers": ["issue_id", "name"],
    "series": ["issue_id", "series_code"], "investor_categories": ["category_code"], "series_category_terms": ["issue_id", "series_code", "category_code"], "series_provenance": ["issue_id", "series_code", "page_number", "source_field"],
}
#: The categories that are known from the beginning.
CATEGORIES = ["I", "II", "III", "IV"]
#: These are inserted if absent and never changed.
ADDED_ONLY = {"issuers", "ratings", "lead_managers", "investor_categories", "series_provenance"}


def loaded(docs: DataFrame, root: str) -> None:
    """All relational rows of docs into the tables under root; loading a document again changes nothing."""
    for name, rows in canonical.relational(docs).items():
        load.merge_into(docs.sparkSession, f"{root}/{name}", rows, KEYS[name], name not in ADDED_ONLY)


def seeded(spark: SparkSession, root: str) -> None:
    """Make the tables that are missing, empty, and the known categories; tables that exist stay as they are."""
    none = spark.createDataFrame([], schema.DOCUMENT)
    for name, rows in canonical.relational(none).items():
        load.merge_into(spark, f"{root}/{name}", rows, KEYS[name], False)
    known = spark.createDataFrame([(c, f"Category {c}") for c in CATEGORIES], "category_code string, category_name string")
    load.merge_into(spark, f"{root}/investor_categories", known, KEYS["investor_categories"], False)


def linked(docs: DataFrame, root: str) -> None:
    """The property graph of docs into the vertices and edges under root: nodes are added once, a later edge of the same ends wins."""
    vertices, edges = canonical.property_graph(docs)
    load.merge_into(docs.sparkSession, f"{root}/vertices", vertices, ["label", "id"], False)
    load.merge_into(docs.sparkSession, f"{root}/edges", edges, ["source", "type", "target"], True)


def watched(spark: SparkSession, inbox: str, root: str, checkpoint: str) -> StreamingQuery:
    """Start loading every new file of inbox; a replayed batch is harmless."""
    docs = spark.readStream.schema(schema.DOCUMENT).option("multiLine", "true").json(inbox)
    return docs.writeStream.foreachBatch(lambda batch, _: loaded(batch, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts of events by type and window, late rows within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


#: What refers to what: (table, columns, table whose key they are).
REFERENCES = [
    ("documents", ["issuer_name"], "issuers"), ("series_category_terms", ["category_code"], "investor_categories"), ("series_category_terms", ["issue_id", "series_code"], "series"),
    ("series_provenance", ["issue_id", "series_code"], "series"),
]


def changes_of(docs: DataFrame) -> dict[str, snapshots.Change]:
    """The relational rows of docs by table, for one load of all tables together."""
    named = lambda t: [(columns, other) for name, columns, other in REFERENCES if name == t]
    return {name: snapshots.Change(rows, KEYS[name], name not in ADDED_ONLY, named(name)) for name, rows in canonical.relational(docs).items()}


def loaded_together(docs: DataFrame, store: snapshots.Store) -> int:
    """All nine tables of docs as one new snapshot of the store: readers see all of it or nothing. Only touched buckets are rewritten."""
    return store.load(changes_of(docs))


def watched_together(store: snapshots.Store, inbox: str, checkpoint: str) -> StreamingQuery:
    """Start loading every new file of inbox into the store, all tables of a batch as one snapshot; a replayed batch changes no table."""
    docs = store.spark.readStream.schema(schema.DOCUMENT).option("multiLine", "true").json(inbox)
    return docs.writeStream.foreachBatch(lambda batch, _: loaded_together(batch, store) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
