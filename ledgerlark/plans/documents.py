"""More queries of the engine's own operators: nested documents, the tools' look-ups, candidates, cells, contents.

An order stands for a document with one issue, its line items for the series. They register themselves beside those of catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlark import schema
from ledgerlark.functions import text
from ledgerlark.operators import assembly, canonical, chunking, entities, graph, retrieval, search, staging, structure, tables, vector
from ledgerlark.plans.catalogue import _PARTICIPANTS, Tables, _branches, query

# --- nested documents -----------------------------------------------------------------------------------------


def _documents(t: Tables) -> DataFrame:
    """schema.DOCUMENT from orders and line items."""
    d = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    place = lambda page: F.struct(d.alias("document_id"), page.cast("int").alias("page"), F.lit(None).cast("string").alias("source_text"), F.lit(None).cast("array<double>").alias("bbox"))
    fact = lambda value, page, unit=None: F.when(value.isNotNull(), F.struct(value.cast("string").alias("value"), F.lit(unit).cast("string").alias("unit"), value.cast("string").alias("raw_value"), F.array(place(page)).alias("provenance")))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("n")))).alias("lines"))
    none = F.lit(None).cast(schema.FACT)
    empty = F.create_map().cast(f"map<string,{schema.FACT}>")

    def series(x):
        own = {"tenor": fact(F.nullif(x["l_returnflag"], F.lit("N")), x["l_linenumber"]), "minimum_application": fact(F.concat(x["n"].cast("string"), F.lit(" units")), x["l_linenumber"] + 1, "units"), "face_value": fact(x["n"] * 10, x["l_linenumber"], "INR")}
        terms = F.struct(*[own.get(n, none).cast(schema.FACT).alias(n) for n in schema.TERMS], empty.alias("additional_terms"))
        rates = F.create_map(F.lit("coupon"), fact(x["n"], x["l_linenumber"], "percent").cast(schema.FACT))
        one = F.array(F.struct(F.lit("I_II").alias("category_id"), F.lit(None).cast("string").alias("category_name"), rates.alias("terms")).cast(schema.CATEGORY))
        split = F.when(x["l_linestatus"] == "O", one).otherwise(F.array().cast(f"array<{schema.CATEGORY}>"))
        number = x["l_linenumber"].cast("string")
        return F.struct(number.alias("series_id"), F.concat(F.lit("Series "), number).alias("series_name"), terms.alias("terms"), split.alias("categories"), F.array(place(x["l_linenumber"])).alias("provenance")).cast(schema.SERIES)

    def rating(x):
        return F.struct(F.concat(F.lit("Agency "), x["l_linestatus"]).alias("agency"), x["l_returnflag"].alias("rating"), F.when(x["n"] > 25, "Stable").alias("outlook"), F.lit("NCD").alias("instrument"), F.lit(None).cast("string").alias("rating_date"), F.array(place(x["l_linenumber"])).alias("provenance")).cast(schema.RATING)

    rows = t.orders.join(lines, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))
    own = {"base_issue_size": fact(F.concat(F.col("o_custkey").cast("string"), F.lit(" crore")), F.lit(1), "crore"), "listing_exchange": fact(F.when(F.col("o_orderstatus") == "O", F.lit("BSE")), F.lit(2))}
    terms = F.struct(*[own.get(n, none).cast(schema.FACT).alias(n) for n in schema.ISSUE_TERMS], F.create_map(F.lit("put_call_option"), fact(F.col("o_orderpriority"), F.lit(1)).cast(schema.FACT)).alias("additional_terms"))
    managers = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("First Managers"), F.lit("Second Managers"))).otherwise(F.array().cast("array<string>"))
    fields = [
        F.concat(d, F.lit("_issue_1")).alias("issue_id"), F.concat(F.lit("Issue "), "o_orderstatus").alias("issue_name"), terms.alias("terms"), F.concat(F.lit("Trustee "), "o_orderpriority").alias("debenture_trustee"),
        managers.alias("lead_managers"), F.transform("lines", rating).alias("ratings"), F.transform("lines", series).alias("series"),
    ]
    kinds = StructType.fromDDL(f"issue {schema.ISSUE}")["issue"].dataType
    issue = F.struct(*[c.cast(k.dataType).alias(k.name) for c, k in zip(fields, kinds, strict=True)])  # each by itself, so that only what a query reads is made
    document = F.struct(d.alias("document_id"), d.alias("document_name"), F.lit("Bond/NCD Prospectus").alias("document_type"), F.lit(None).cast("string").alias("document_date"), F.lit(9).alias("page_count"))
    issuer = F.struct(F.concat(d, F.lit("_issuer")).alias("issuer_id"), F.concat(F.lit("Issuer "), F.col("o_custkey").cast("string")).alias("name"), F.array(issue).alias("issues"))
    blank = F.lit(None).cast("string")
    chunk = F.struct(F.concat(d, F.lit("_0001")).alias("chunk_id"), F.lit("prose").alias("chunk_type"), F.when(F.col("o_orderstatus") != "P", F.lit("Prose")).otherwise(" ").alias("text"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"), F.array(F.lit("Terms"), F.lit("Notes")).alias("section_path"), blank.alias("series_id"), blank.alias("category_id"), F.array(place(F.lit(1))).alias("provenance")).cast(schema.CHUNK)
    return rows.select(document.alias("document"), issuer.alias("issuer"), F.array(chunk).alias("chunks"))


_SHOWN = ["document_id", "chunk_id", "chunk_type", "text", "series_id", "category_id"]


@query("""
SELECT 'o' || o_orderkey AS document_id, 'o' || o_orderkey || '_issue_1_overview' AS chunk_id, 'structured_fact' AS chunk_type, NULL::VARCHAR AS series_id, NULL::VARCHAR AS category_id,
 concat_ws(chr(10), 'Issuer: Issuer ' || o_custkey, 'Issue: Issue ' || o_orderstatus, 'Base Issue Size: ' || o_custkey || ' crore', CASE WHEN o_orderstatus = 'O' THEN 'Listing Exchange: BSE' END, 'Debenture Trustee: Trustee ' || o_orderpriority,
  CASE WHEN o_orderstatus = 'F' THEN 'Lead Managers: First Managers, Second Managers' END, 'Put Call Option: ' || o_orderpriority) AS text FROM orders""")
def overview_chunk(spark, sf):
    return canonical.overview_chunks(_documents(Tables(spark, sf))).select(*_SHOWN)


_LINES = "(SELECT *, l_quantity::BIGINT AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity::BIGINT) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""
SELECT 'o' || l_orderkey AS document_id, 'o' || l_orderkey || '_issue_1_rating_' || r AS chunk_id, 'structured_fact' AS chunk_type, NULL::VARCHAR AS series_id, NULL::VARCHAR AS category_id,
 concat_ws(chr(10), 'Issuer: Issuer ' || o_custkey, 'Rating Agency: Agency ' || l_linestatus, 'Rating: ' || l_returnflag, CASE WHEN n > 25 THEN 'Outlook: Stable' END) AS text FROM {_LINES}""")
def rating_chunks(spark, sf):
    return canonical.rating_chunks(_documents(Tables(spark, sf))).select(*_SHOWN)


@query(f"""
SELECT 'o' || l_orderkey AS document_id, 'o' || l_orderkey || '_issue_1_series_' || l_linenumber || CASE WHEN l_linestatus = 'O' THEN '_cat_I_II' ELSE '' END AS chunk_id, 'structured_fact' AS chunk_type,
 l_linenumber::VARCHAR AS series_id, CASE WHEN l_linestatus = 'O' THEN 'I_II' END AS category_id,
 concat_ws(chr(10), 'Issuer: Issuer ' || o_custkey, 'Series: ' || l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'Category: Category I and Category II' END, 'Tenor: ' || nullif(l_returnflag, 'N'),
  'Minimum Application: ' || n || ' units', 'Face Value: ' || n * 10 || ' INR', CASE WHEN l_linestatus = 'O' THEN 'Coupon: ' || n END) AS text FROM {_LINES}""")
def structured_fact_chunks(spark, sf):
    return canonical.series_chunks(_documents(Tables(spark, sf))).select(*_SHOWN)


@query("""
SELECT 'o' || o_orderkey AS document_id, 1 AS issues, count(l_orderkey) AS series, count(l_orderkey) AS ratings, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS lead_managers, 0 AS structured_facts,
 CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS prose, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS skipped FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def load_summary(spark, sf):
    return canonical.load_summary(_documents(Tables(spark, sf)))


@query(f"""
SELECT 'o' || l_orderkey || '_issue_1' AS issue_id, l_linenumber::VARCHAR AS series_code, 'Series ' || l_linenumber AS series_identifier, nullif(l_returnflag, 'N') AS tenor, n || ' units' AS minimum_application, n * 10 AS face_value_inr FROM {_LINES}""")
def relational_series(spark, sf):
    rows = canonical.relational(_documents(Tables(spark, sf)))["series"]
    return rows.select("issue_id", "series_code", "series_identifier", "tenor", "minimum_application", F.col("face_value_inr").cast("long").alias("face_value_inr"))


@query(f"""
SELECT DISTINCT issue_id, l_linenumber::VARCHAR AS series_code, page_number, source_field FROM (
 SELECT 'o' || l_orderkey || '_issue_1' AS issue_id, l_linenumber, l_linenumber AS page_number, unnest(['series', 'face_value', CASE WHEN l_returnflag <> 'N' THEN 'tenor' END]) AS source_field FROM {_LINES}
 UNION ALL SELECT 'o' || l_orderkey || '_issue_1', l_linenumber, l_linenumber + 1, 'minimum_application' FROM {_LINES}) WHERE source_field IS NOT NULL""")
def relational_provenance(spark, sf):
    return canonical.relational(_documents(Tables(spark, sf)))["series_provenance"]


@query(f"""
SELECT 'o' || l_orderkey || '_issue_1' AS issue_id, l_linenumber::VARCHAR AS series_code, unnest(['I', 'II']) AS category_code, n AS coupon_percent FROM {_LINES} WHERE l_linestatus = 'O'""")
def relational_category_terms(spark, sf):
    rows = canonical.relational(_documents(Tables(spark, sf)))["series_category_terms"]
    return rows.select("issue_id", "series_code", "category_code", F.col("coupon_percent").cast("long").alias("coupon_percent"))


@query(f"""
WITH o AS (SELECT 'o' || o_orderkey || '_issue_1' AS id, * FROM orders)
SELECT 'Issuer ' || o_custkey AS source, 'ISSUED' AS type, id AS target, NULL::VARCHAR AS outlook FROM o UNION SELECT id, 'HAS_DEBENTURE_TRUSTEE', 'Trustee ' || o_orderpriority, NULL FROM o
UNION SELECT id, 'HAS_LEAD_MANAGER', unnest(['First Managers', 'Second Managers']), NULL FROM o WHERE o_orderstatus = 'F'
UNION SELECT 'o' || l_orderkey || '_issue_1', 'HAS_SERIES', l_linenumber::VARCHAR, NULL FROM {_LINES}
UNION SELECT 'o' || l_orderkey || '_issue_1', 'RATED_BY', 'Agency ' || l_linestatus, arg_max(coalesce(outlook, '-'), r) FROM (SELECT *, CASE WHEN n > 25 THEN 'Stable' END AS outlook FROM {_LINES}) GROUP BY l_orderkey, l_linestatus""")
def graph_edges(spark, sf):
    _, edges = canonical.property_graph(_documents(Tables(spark, sf)))
    return edges.withColumn("outlook", F.when(F.col("type") == "RATED_BY", F.coalesce("outlook", F.lit("-"))))


@query("""
SELECT doc_id, source AS section, lang AS subsection, concat_ws(' > ', source, lang) AS section_path FROM documents WHERE trim(text, E' \\n\\t\\r') <> '' AND doc_id % 3 <> 0
UNION ALL SELECT doc_id, '', '', '' FROM documents WHERE trim(text, E' \\n\\t\\r') <> '' AND doc_id % 3 = 0""")
def stored_payload(spark, sf):
    """A third of the chunks has no section path."""
    chunks = Tables(spark, sf).documents.withColumn("chunk_id", F.col("doc_id").cast("string")).withColumn("section_path", F.when(F.col("doc_id") % 3 != 0, F.array("source", "lang")))
    return canonical.payload(chunks).select("doc_id", "section", "subsection", "section_path")


# --- the tools' look-ups --------------------------------------------------------------------------------------


def _tables(t: Tables) -> dict[str, DataFrame]:
    """The relational tables, from the star tables: a nation is an issuer, a customer a document, an order an issue, a line item a series."""
    text_of = lambda c, name: F.col(c).cast("string").alias(name)
    issues = t.orders.join(search.small(t.customer), F.col("o_custkey") == F.col("c_custkey"))
    # by issues, in partitions that follow the rows, so that rows are made distinct where they lie, in memory that does not grow
    lines = staging.spread(t.lineitem.select(text_of("l_orderkey", "issue_id"), text_of("l_linenumber", "series_code"), "l_returnflag", "l_linestatus", "l_quantity"), t.lineitem.count(), "issue_id")
    return {
        "documents": t.customer.join(search.small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("n_name AS issuer_name", "c_name AS document_name"),
        "issues": issues.select(F.col("c_name").alias("document_name"), text_of("o_orderkey", "issue_identifier"), F.col("o_orderpriority").alias("issue_name"), F.col("o_orderstatus").alias("base_issue_size"), F.col("c_mktsegment").alias("debenture_trustee")),
        "series": lines.select("issue_id", "series_code").distinct().withColumn("tenor", F.concat(F.lit("tenor of "), "series_code")),
        "series_category_terms": lines.select("issue_id", "series_code", F.col("l_returnflag").alias("category_code"), F.col("l_linestatus").alias("coupon_percent")).distinct(),
        "series_provenance": lines.select("issue_id", "series_code", F.col("l_quantity").cast("long").alias("page_number"), F.lit("series").alias("source_field")),
        "ratings": lines.select("issue_id", "l_returnflag", "l_linestatus").distinct().select("issue_id", F.concat(F.lit("Agency "), "l_returnflag").alias("agency"), F.col("l_linestatus").alias("rating"), *[F.lit(None).cast("string").alias(c) for c in ("outlook", "instrument", "rating_date")]),
        "lead_managers": lines.select("issue_id", "l_linestatus").distinct().select("issue_id", F.concat(F.lit("Manager "), "l_linestatus").alias("name")),
    }


_STAR = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_TERMS = f"""(SELECT o_orderkey || ':' || l_linenumber AS series_id, n_name AS issuer, c_name AS document_name, o_orderpriority AS issue_name, l_linenumber::VARCHAR AS series_code, 'tenor of ' || l_linenumber AS tenor,
 l_returnflag AS category_code, l_linestatus AS coupon_percent, page AS first_page, 'Series ' || l_linenumber || ' / Category ' || l_returnflag AS section
 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem) JOIN (SELECT l_orderkey AS k, l_linenumber AS n, min(l_quantity)::BIGINT AS page FROM lineitem GROUP BY 1, 2) ON k = l_orderkey AND n = l_linenumber
 JOIN {_STAR} ON l_orderkey = o_orderkey)"""


@query(f"SELECT * FROM {_TERMS} WHERE tenor LIKE '%of 2%'")
def bond_terms(spark, sf):
    found = search.bond_terms(_tables(Tables(spark, sf)), tenor="of 2", issuer="")
    return found.select("series_id", "issuer", "document_name", "issue_name", "series_code", "tenor", "category_code", "coupon_percent", "first_page", "section")


@query(f"""
SELECT o_orderkey::VARCHAR AS issue_id, n_name AS issuer, c_name AS document_name, o_orderpriority AS issue_name, o_orderstatus AS issue_size, c_mktsegment AS debenture_trustee, coalesce(r, '') AS ratings, coalesce(m, '') AS lead_managers FROM {_STAR}
LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS r, string_agg(DISTINCT 'Manager ' || l_linestatus, ',' ORDER BY 'Manager ' || l_linestatus) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def issue_facts(spark, sf):
    found = search.issue_facts(_tables(Tables(spark, sf)))
    rated = F.array_join(F.transform("ratings", lambda r: F.concat(F.replace(r["agency"], F.lit("Agency "), F.lit("")), r["rating"])), ",")
    return found.select("issue_id", "issuer", "document_name", "issue_name", "issue_size", "debenture_trustee", rated.alias("ratings"), F.array_join("lead_managers", ",").alias("lead_managers"))


@query(f"""
SELECT DISTINCT o_orderkey::VARCHAR AS issue_id, n_name AS issuer, o_orderpriority AS issue_name, c_name AS document_name, p AS participant_name, role AS participant_role FROM {_STAR} JOIN (
 SELECT o_orderkey AS k, c_mktsegment AS p, 'DebentureTrustee' AS role FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT l_orderkey, 'Manager ' || l_linestatus, 'LeadManager' FROM lineitem UNION SELECT l_orderkey, 'Agency ' || l_returnflag, 'RatingAgency' FROM lineitem) ON k = o_orderkey""")
def participations(spark, sf):
    return search.participations(_tables(Tables(spark, sf)))


@query(_PARTICIPANTS.format("c", "customer", "LeadManager"))
def participant_manager(spark, sf):
    return graph.participants(_branches(Tables(spark, sf)), "00001", "LeadManager")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def in_list(spark, sf):
    t = Tables(spark, sf)
    return search.among(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")))


_CANDIDATE = "'[SQL] ' || document_name || ' — ' || section AS label, issuer || ' Series ' || series_code || ' Category ' || category_code || ': tenor ' || tenor || ', coupon ' || coupon_percent || '%.' AS text, 1.0::DOUBLE AS score"


@query(f"""
WITH q AS (SELECT n_nationkey AS question_id, n_name, n_nationkey % 3 AS k FROM nation), t AS (SELECT * FROM {_TERMS}),
i AS (SELECT * FROM {_STAR}),
r AS (SELECT l_orderkey, string_agg('Agency ' || l_returnflag || ': ' || l_linestatus, '; ' ORDER BY l_returnflag, l_linestatus) AS r FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem) GROUP BY 1),
m AS (SELECT l_orderkey, string_agg('Manager ' || l_linestatus, ', ' ORDER BY l_linestatus) AS m FROM (SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem) GROUP BY 1),
o AS (SELECT question_id, 'sql:issue:' || o_orderkey AS source_id, '[SQL] ' || c_name || ' — ' || o_orderpriority AS label,
  i.n_name || ' (' || o_orderpriority || '): ' || concat_ws(', ', 'issue size ' || o_orderstatus, 'debenture trustee ' || c_mktsegment, 'ratings - ' || r, 'lead managers - ' || m) || '.' AS text, 1.0::DOUBLE AS score,
  row_number() OVER (PARTITION BY question_id ORDER BY o_orderkey::VARCHAR) AS n FROM q JOIN i ON i.n_name = q.n_name LEFT JOIN r ON r.l_orderkey = o_orderkey LEFT JOIN m ON m.l_orderkey = o_orderkey WHERE k = 0),
p AS (SELECT question_id, 'graph:' || o_orderkey || ':DebentureTrustee:' || c_mktsegment AS source_id, '[Graph] ' || c_name || ' — DebentureTrustee' AS label, i.n_name || ' (' || o_orderpriority || ', ' || c_name || '): ' || c_mktsegment || ' served as DebentureTrustee.' AS text, 1.0::DOUBLE AS score,
  row_number() OVER (PARTITION BY question_id ORDER BY o_orderkey::VARCHAR) AS n FROM q JOIN i ON c_mktsegment = 'BUILDING' WHERE k = 1)
SELECT question_id, source_id, label, text, score FROM o WHERE n <= 200 UNION ALL SELECT question_id, source_id, label, text, score FROM p WHERE n <= 200""")
def structured_candidates(spark, sf):
    """Questions on the overview of an issuer, on a participant, and on nothing known."""
    t = Tables(spark, sf)
    k = F.col("n_nationkey") % 3
    asked = F.when(k == 0, F.concat(F.lit("Who is the trustee of "), F.lower("n_name"), F.lit("?"))).when(k == 1, F.lit("Where does Building act?")).otherwise("What is a bond?")
    return retrieval.structured_candidates(t.nation.select(F.col("n_nationkey").alias("question_id"), asked.alias("question")), _tables(t)).select("question_id", "source_id", "label", "text", "score")


@query(f"""
SELECT question_id, source_id, label, text, score FROM (SELECT n_nationkey AS question_id, 'sql:series:' || series_id AS source_id, {_CANDIDATE}, row_number() OVER (PARTITION BY n_nationkey ORDER BY series_code, category_code, series_id, coupon_percent) AS n
 FROM nation JOIN {_TERMS} ON issuer = n_name AND category_code = 'A') WHERE n <= 200""")
def term_candidates(spark, sf):
    """Every nation's series of one category; the categories are letters here, so the question's numeral is mapped to one."""
    t = Tables(spark, sf)
    stored = _tables(t)
    numeral = F.when(F.col("category_code") == "A", "II").otherwise("X")
    stored["series_category_terms"] = stored["series_category_terms"].withColumn("category_code", numeral)
    stored["ratings"], stored["lead_managers"] = stored["ratings"].limit(0), stored["lead_managers"].limit(0)
    asked = t.nation.select(F.col("n_nationkey").alias("question_id"), F.concat(F.lit("Coupon of Category II by "), "n_name").alias("question"))
    found = retrieval.structured_candidates(asked, stored, 200)
    named = lambda c: F.replace(c, F.lit("Category II"), F.lit("Category A")).alias(c)
    return found.select("question_id", "source_id", named("label"), named("text"), "score")


@query("""
SELECT source_id, score FROM (SELECT 'v' || vec_id AS source_id, 1.0::DOUBLE AS score, label FROM embeddings WHERE label % 2 = 1 UNION ALL SELECT 'v' || vec_id, 0.5, label FROM embeddings WHERE label % 2 = 0) WHERE label <> 0""")
def candidate_dedup(spark, sf):
    """All rows from one source, those of odd labels from an earlier one too; those of label 0 were seen."""
    e = Tables(spark, sf).embeddings.selectExpr("concat('v', vec_id) AS source_id", "'t' AS text", "string(label) AS label", "label AS l")
    found = retrieval.candidates([e.filter("l % 2 = 1").withColumn("score", F.lit(1.0)), e.withColumn("score", F.lit(0.5))])
    return retrieval.unseen(found, e.filter("l = 0")).select("source_id", "score")


@query()
def vector_candidates(spark, sf):
    """The benchmark's texts ask the documents, which are embedded some megabytes at a time."""
    staging.small_batches(spark)
    t = Tables(spark, sf)
    none = F.lit(None).cast("string")
    chunks = t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("document_name"), F.lit(1).alias("start_page"), F.col("lang").alias("section_path"), none.alias("series_id"), none.alias("category_id"))
    embed = vector.hashing_embedder()
    return retrieval.vector_candidates(t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question")), vector.embedded(chunks, embed), embed).select("question_id", "source_id", "label", "atom")


# --- labels, facts, entities ----------------------------------------------------------------------------------


@query(r"""
SELECT o_orderkey, nullif(CASE k WHEN 0 THEN 'Series II' WHEN 1 THEN 'Nr. ' || o_custkey ELSE '' END, '') AS value, CASE k WHEN 0 THEN 'II' WHEN 1 THEN NULL END AS series, k = 3 AS cell, k IN (0, 2) AS named
FROM (SELECT *, o_orderkey % 4 AS k FROM orders) WHERE k < 3 UNION ALL SELECT o_orderkey, 'iv*', 'IV', true, false FROM orders WHERE o_orderkey % 4 = 3""")
def series_labels(spark, sf):
    k = F.col("o_orderkey") % 4
    cell = F.when(k == 0, F.lit(" Series \n II")).when(k == 1, F.concat(F.lit("Nr.\t "), F.col("o_custkey").cast("string"))).when(k == 2, F.lit(" \n ")).otherwise("iv*")
    row = F.array(cell, F.when(k == 2, F.lit(" SERIES ")).otherwise("x"))
    numeral = F.when(k == 0, F.lit("II")).otherwise(cell)
    return Tables(spark, sf).orders.select("o_orderkey", text.clean_value(cell).alias("value"), text.series_id(numeral).alias("series"), text.is_series_cell(cell).alias("cell"), text.has_series_word(row).alias("named"))


@query("SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) || ' Of ' || p_size AS title, CASE WHEN p_size % 2 = 0 THEN '_' || p_size || '_of' ELSE 'x_' || p_size END AS identifier, p_size % 3 = 0 AS reference FROM part WHERE p_type NOT LIKE '% %' AND p_type NOT LIKE '%\\_%' ESCAPE '\\'")
def field_labels(spark, sf):
    size = F.col("p_size").cast("string")
    safe = F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit("-of"))).otherwise(F.concat(F.lit(" x "), size))
    said = F.when(F.col("p_size") % 3 == 0, F.lit("Please  refer to page 3")).otherwise("9.5 %")
    return Tables(spark, sf).part.filter("NOT p_type LIKE '% %' AND NOT contains(p_type, '_')").select("p_partkey", text.field_title(F.concat_ws("_", "p_type", F.lit("of"), size)).alias("title"), text.identifier(safe).alias("identifier"), text.is_reference_text(said).alias("reference"))


@query("SELECT l_orderkey, string_agg(p::VARCHAR, ',' ORDER BY f) AS pages, min(p) AS first_page FROM (SELECT l_orderkey, l_linenumber AS p, min(l_quantity) AS f FROM (SELECT l_orderkey, l_linenumber, l_quantity * 1000 + l_linenumber AS l_quantity FROM lineitem) GROUP BY 1, 2) GROUP BY 1")
def merged_places(spark, sf):
    """Pages in the order in which they are first named, each once."""
    line = F.struct((F.col("l_quantity") * 1000 + F.col("l_linenumber")).alias("at"), F.col("l_linenumber").alias("page"))
    rows = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    kept = canonical.merged_provenance(F.transform("l", lambda x: F.struct(F.lit("d").alias("document_id"), x["page"].alias("page"))))
    pages = F.transform(kept, lambda p: p["page"])
    return rows.select("l_orderkey", F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("pages"), canonical.first_page(pages).alias("first_page"))


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN k >= 1 THEN 'I' END, CASE WHEN k IN (0, 3) THEN 'II' END, CASE WHEN k >= 2 THEN 'I_II' END) AS categories FROM (SELECT *, o_orderkey % 4 AS k FROM orders)""")
def category_union(spark, sf):
    k = F.col("o_orderkey") % 4
    of = lambda name, when: F.when(when, F.create_map(F.lit(name), F.lit(1.0)))
    maps = [of("I", k >= 1), of("II", k.isin(0, 3)), of("I_II", k >= 2), of("I", k == 3)]
    known = F.array_join(F.transform(F.array_sort(canonical.category_ids(maps), lambda a, b: F.length(a) - F.length(b)), lambda c: c), ",")
    return Tables(spark, sf).orders.select("o_orderkey", known.alias("categories"))


@query("""
SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS status, min(o_orderkey) FILTER (o_orderstatus <> 'O') AS status_page, arg_min(o_orderpriority, o_orderkey) AS priority, min(o_orderkey) AS priority_page FROM orders GROUP BY 1""")
def facts_over_pages(spark, sf):
    o = Tables(spark, sf).orders
    return entities.first_over_pages(o, ["o_custkey"], "o_orderkey", {"status": F.nullif("o_orderstatus", F.lit("O")), "priority": F.col("o_orderpriority")})


@query("""
SELECT l_orderkey, arg_min('Agency ' || l_returnflag, q) AS agency, l_linestatus AS rating, arg_min(q::VARCHAR, q) AS outlook, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS pages
FROM (SELECT *, (l_quantity * 1000)::BIGINT + l_linenumber * 100 + l_partkey % 100 AS q FROM lineitem) GROUP BY l_orderkey, l_returnflag, l_linestatus""")
def rating_groups(spark, sf):
    q = (F.col("l_quantity") * 1000).cast("long") + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100
    rows = Tables(spark, sf).lineitem.withColumn("seq", q).select("l_orderkey", F.concat(F.lit("Agency "), "l_returnflag").alias("agency"), F.col("l_linestatus").alias("rating"), F.col("seq").cast("string").alias("outlook"), F.lit(None).cast("string").alias("rating_date"), "seq", F.col("l_linenumber").alias("page"))
    return entities.ratings(rows, ("l_orderkey",)).select("l_orderkey", "agency", "rating", "outlook", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("SELECT doc_id, source || '_' || lpad((row_number() OVER (PARTITION BY source ORDER BY doc_id))::VARCHAR, 4, '0') AS chunk_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) < 10000 UNION ALL SELECT doc_id, source || '_' || r FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r >= 10000")
def numbered_chunks(spark, sf):
    return entities.numbered(Tables(spark, sf).documents.select("doc_id", "source"), "source", ["doc_id"], "source").select("doc_id", "chunk_id")


@query("SELECT l_orderkey, string_agg('line ' || l_linenumber || ' ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def page_texts(spark, sf):
    line = F.when(F.col("l_returnflag") == "N", F.lit("  ")).otherwise(F.concat(F.lit(" line "), F.col("l_linenumber").cast("string"), F.lit(" "), "l_returnflag", F.lit(" ")))
    return chunking.page_texts(Tables(spark, sf).lineitem.withColumn("line", line), ["l_orderkey"], "l_linenumber", "line")


# --- structure and tables -------------------------------------------------------------------------------------


def _contents(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Lines of contents on page 2 and headings: twenty parts a document, each printed 2 to 4 pages before its place in the file."""
    part = t.part.withColumn("document", F.floor(F.col("p_partkey") / 20).cast("string")).withColumn("no", (F.col("p_partkey") % 20).cast("int"))
    title = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    printed = F.col("no") + 10
    found = part.select("document", (printed + 2 + F.floor(F.col("p_partkey") / 20) % 3).cast("int").alias("page_number"), F.col("no").alias("line_no"), title.alias("text"), F.col("p_size").cast("double").alias("size"), F.lit(True).alias("bold"))
    lines = part.select("document", F.lit(2).alias("page_number"), F.col("no").alias("line_no"), F.concat(title, F.lit(" ..... "), printed.cast("string")).alias("text"), F.array(10.0 + 20 * (F.col("p_size") % 2), *[F.lit(0.0)] * 3).alias("bbox"))
    return lines, found


_PLACED = "(SELECT p_partkey // 20 AS d, (p_partkey % 20)::INT AS no, p_name || ' ' || p_partkey AS title, dense_rank() OVER (PARTITION BY p_partkey // 20 ORDER BY p_size % 2) AS level FROM part)"


@query(f"SELECT d::VARCHAR AS document, no + 1 AS section_no, level, title, no + 10 AS printed_page, (no + 12 + d % 3)::INT AS resolved_page, true AS confirmed, title AS matched_text FROM {_PLACED}")
def toc_resolve(spark, sf):
    return structure.sections(*_contents(Tables(spark, sf))).drop("similarity")


@query(f"SELECT d::VARCHAR AS document, 1.0::DOUBLE AS share FROM {_PLACED} GROUP BY 1")
def confirmed_share(spark, sf):
    return structure.confirmed_share(structure.sections(*_contents(Tables(spark, sf))))


@query(f"SELECT d::VARCHAR AS document, CASE WHEN d % 2 = 0 THEN 'outline' ELSE 'contents' END AS strategy, no + 1 AS section_no, title, (no + 12 + d % 3)::INT AS start_page FROM {_PLACED}")
def structure_strategy(spark, sf):
    """Every other document has an outline that its contents confirm."""
    lines, found = _contents(Tables(spark, sf))
    even = F.col("document").cast("long") % 2 == 0
    outline = found.select("document", (F.col("line_no") + 1).alias("section_no"), F.lit(1).alias("level"), F.when(even, F.col("text")).otherwise("~").alias("title"), F.col("page_number").alias("page"))
    totals = found.select("document", F.lit(60).alias("total_pages")).distinct()
    return structure.detected(outline, lines, found, totals).select("document", "strategy", "section_no", "title", "start_page")


@query("SELECT p_brand AS document, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, (p_partkey % 3 = 0) DESC, p_partkey) AS r FROM part) WHERE r <= 40")
def strongest_headings(spark, sf):
    rows = Tables(spark, sf).part.selectExpr("p_brand AS document", "p_partkey", "p_size AS size", "p_partkey % 3 = 0 AS bold", "p_partkey AS page_number", "1 AS line_no")
    return structure.strongest(rows).select("document", "p_partkey")


def _cells(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """A table of terms for each order: two series, one value of both, one reference; a label more where the key is odd."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    cell = lambda row, col, body, x0, x1: F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), body.alias("text"), F.lit(float(x0)).alias("x0"), F.lit(10.0 * row).alias("top"), F.lit(float(x1)).alias("x1"), F.lit(10.0 * row + 10).alias("bottom"))
    rate = F.concat((cust % 10).cast("string"), F.lit(".5%"))
    cells = [
        cell(0, 0, F.lit("Series"), 0, 50), cell(0, 1, F.lit("I"), 50, 90), cell(0, 2, F.lit("ii*"), 90, 130),
        cell(1, 0, F.lit("Tenor"), 0, 50), cell(1, 1, F.concat(cust.cast("string"), F.lit(" months")), 50, 90), cell(1, 2, F.lit("Please refer to page 9"), 90, 130),
        cell(2, 0, F.lit("Coupon (% p.a.) Category I & II"), 0, 50), cell(2, 1, rate, 50, 130), cell(3, 0, F.when(key % 2 == 1, F.lit("Put and Call Option")).otherwise("Notes"), 0, 50), cell(3, 1, F.lit("None"), 50, 130),
    ]
    orders = t.orders if orders is None else orders
    return orders.select(key.cast("string").alias("document_id"), F.lit(4).alias("page"), F.lit(0).alias("table_idx"), F.explode(F.array(*cells)).alias("c")).select("document_id", "page", "table_idx", "c.*")


_COUPON = "SELECT o_orderkey::VARCHAR AS document_id, unnest(['I', 'II']) AS series_id"


@query(f"""
SELECT o_orderkey::VARCHAR AS document_id, 'I' AS series_id, 'tenor' AS field, NULL::VARCHAR AS category, o_custkey || ' months' AS value_text, NULL::DOUBLE AS value_num, '4' AS pages FROM orders
UNION ALL {_COUPON}, 'coupon', 'I_II', NULL, o_custkey % 10 + 0.5, '4' FROM orders UNION ALL {_COUPON}, 'put_call_option', NULL, 'None', NULL, '4' FROM orders WHERE o_orderkey % 2 = 1""")
def series_terms(spark, sf):
    rows = tables.series_terms(_cells(Tables(spark, sf)))
    return rows.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query("SELECT o_orderkey::VARCHAR AS document_id, 4 + CASE WHEN o_orderkey % 2 = 1 THEN 4 ELSE 2 END AS score FROM orders")
def table_scores(spark, sf):
    return tables.table_scores(_cells(Tables(spark, sf))).select("document_id", "score")


@query("SELECT o_orderkey::VARCHAR AS document_id, count(*) AS cells FROM orders, range(10) WHERE o_orderstatus <> 'F' GROUP BY 1")
def consistent_cells(spark, sf):
    """The other scan of the tables of some orders misses a row."""
    t = Tables(spark, sf)
    cells = staging.spread(_cells(t), 10 * t.orders.count(), *tables.TABLE)
    short = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    grid = _cells(t, t.orders.filter(~short)).unionByName(_cells(t, t.orders.filter(short)).filter("row <> 3"))
    kept = tables.consistent(grid, cells)
    return kept.groupBy("document_id").agg(F.count(F.lit(1)).alias("cells"))


@query("""
SELECT o_orderkey::VARCHAR AS document_id, unnest(['I', 'II']) AS series_id, CASE WHEN o_orderkey % 2 = 1 THEN 'None' END AS put_call_option FROM orders""")
def document_series(spark, sf):
    """Series with their facts, from cells, before shared terms leave them."""
    made = assembly.series(tables.series_terms(_cells(Tables(spark, sf))))
    rows = made.select("document_id", F.explode("series").alias("s"))
    return rows.select("document_id", "s.series_id", F.col("s.terms.put_call_option.value").alias("put_call_option"))


@query("SELECT o_orderkey::VARCHAR AS document_id, CASE WHEN o_orderkey % 2 = 1 THEN 'None' END AS hoisted, 0 AS left_on_series FROM orders")
def shared_terms(spark, sf):
    made = assembly.shared(assembly.series(tables.series_terms(_cells(Tables(spark, sf)))))
    kept = F.size(F.filter("series", lambda s: s["terms"]["put_call_option"].isNotNull()))
    return made.select("document_id", F.try_element_at("shared", F.lit("put_call_option"))["value"].alias("hoisted"), kept.alias("left_on_series"))


def _assembled(t: Tables, with_prose: bool) -> DataFrame:
    """schema.DOCUMENT by the whole chain: the orders' tables on page 4, what page 1 says of them, and if wanted page 1 as prose of a section."""
    key, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    size = F.concat(F.lit('about Alpha Finance Limited ("Issuer"). Base Issue Size: ₹ '), F.col("o_custkey").cast("string"), F.lit(" crore"))
    said = F.when(k == 0, "Nothing is named here.").when(k == 1, size).otherwise('about Beta Power Limited ("Issuer"). Tables follow.')
    page = F.explode(F.array(F.struct(F.lit(1).alias("page"), said.alias("text")), F.struct(F.lit(4).alias("page"), F.lit("Terms of the issue").alias("text"))))
    pages = t.orders.select(key.alias("document_id"), page.alias("p")).select("document_id", "p.*")
    cells = _cells(t)
    if not with_prose:
        return assembly.documents(tables.series_terms(cells), pages)
    excluded = tables.header_rows(cells).select(F.col("document_id").alias("document"), "page").distinct()
    sections = t.orders.select(key.alias("document"), F.lit(1).alias("section_no"), F.lit(1).alias("start_page"), F.lit(4).alias("end_page"), F.array(F.lit("Terms")).alias("path"))
    prose = assembly.prose_chunks(chunking.chunks_of_sections(sections, pages.withColumnRenamed("document_id", "document"), excluded))
    return assembly.documents(tables.series_terms(cells), pages, prose)


_ISSUER = "CASE o_orderkey % 3 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'Alpha Finance Limited' ELSE 'Beta Power Limited' END"
_SIZE = "CASE WHEN o_orderkey % 3 = 1 THEN '₹ ' || o_custkey || ' crore' END"


@query(f"""
SELECT o_orderkey::VARCHAR AS document_id, {_ISSUER} AS issuer, 4 AS page_count, {_SIZE} AS base_issue_size, CASE WHEN o_orderkey % 2 = 1 THEN 'None' END AS put_call_option, 'I,II' AS series, o_custkey || ' months' AS tenor, 3 AS chunks FROM orders""")
def assembled_documents(spark, sf):
    """Nested documents made by the chain from cells and pages: facts, issuer, a shared term that went to the issue, series."""
    issue = F.col("issuer.issues")[0]
    names = F.array_join(F.transform(issue["series"], lambda s: s["series_id"]), ",")
    return _assembled(Tables(spark, sf), False).select(
        "document.document_id", F.col("issuer.name").alias("issuer"), "document.page_count", issue["terms"]["base_issue_size"]["value"].alias("base_issue_size"),
        F.try_element_at(issue["terms"]["additional_terms"], F.lit("put_call_option"))["value"].alias("put_call_option"), names.alias("series"), issue["series"][0]["terms"]["tenor"]["value"].alias("tenor"), F.size("chunks").alias("chunks"),
    )


@query(f"""
WITH o AS (SELECT *, o_orderkey::VARCHAR AS document_id, {_ISSUER} AS issuer FROM orders)
SELECT document_id, 1 AS place, document_id || '_issue_1_overview' AS chunk_id, 'structured_fact' AS chunk_type, concat_ws(chr(10), 'Issuer: ' || issuer, 'Base Issue Size: ' || {_SIZE}, CASE WHEN o_orderkey % 2 = 1 THEN 'Put Call Option: None' END) AS text FROM o
UNION ALL SELECT document_id, 2 + k, document_id || '_issue_1_series_' || s || '_cat_I_II', 'structured_fact', concat_ws(chr(10), 'Issuer: ' || issuer, 'Series: ' || s, 'Category: Category I and Category II', CASE k WHEN 0 THEN 'Tenor: ' || o_custkey || ' months' END, 'Coupon: ' || o_custkey % 10 || '.5')
 FROM o, (VALUES (0, 'I'), (1, 'II')) AS v(k, s)
UNION ALL SELECT document_id, 4, document_id || '_0001', 'prose', CASE o_orderkey % 3 WHEN 0 THEN 'Nothing is named here.' WHEN 1 THEN 'about Alpha Finance Limited ("Issuer"). Base Issue Size: ' || {_SIZE} ELSE 'about Beta Power Limited ("Issuer"). Tables follow.' END FROM o""")
def assembled_chunks(spark, sf):
    """All chunks of the documents in their order: facts of the issue, of each series and category, then prose."""
    rows = _assembled(Tables(spark, sf), True).select("document.document_id", F.posexplode("chunks").alias("n", "c"))
    return rows.select("document_id", (F.col("n") + 1).alias("place"), "c.chunk_id", "c.chunk_type", "c.text")
