"""Every query of the engine's own operators, by name, with the SQL that must give the same rows.

The tables stand for the bond model: nation an issuer, customer a document, orders an issue, lineitem a series, part a
category's terms, supplier a participant, documents pages of text, embeddings vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlark.functions import extract, names, text
from ledgerlark.operators import chunking, entities, graph, intervals, load, retrieval, search, structure, tables, vector

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, and the SQL if there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


# --- typed search ---------------------------------------------------------------------------------------------


def _terms(t: Tables) -> DataFrame:
    return search.star(
        t.lineitem,
        [(t.orders, F.col("l_orderkey") == F.col("o_orderkey")), (search.small(t.customer), F.col("o_custkey") == F.col("c_custkey")), (search.small(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))],
        [(search.small(t.part), F.col("l_partkey") == F.col("p_partkey")), (search.small(t.supplier), F.col("l_suppkey") == F.col("s_suppkey"))],
    )


@query("""
SELECT n_name AS issuer, c_name AS document_name, o_orderkey AS issue_id, l_linenumber AS series_code, p_brand AS tenor, s_name AS category_code, l_quantity AS coupon_percent
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
WHERE l_returnflag = 'R' AND p_type LIKE '%E%' ORDER BY l_orderkey NULLS FIRST, l_linenumber NULLS FIRST LIMIT 200""")
def search_terms(spark, sf):
    found = search.matching(_terms(Tables(spark, sf)), {"l_returnflag": "R", "n_name": None}, {"p_type": "E"})
    found = search.capped(found, ["l_orderkey", "l_linenumber"])
    return found.selectExpr("n_name AS issuer", "c_name AS document_name", "o_orderkey AS issue_id", "l_linenumber AS series_code", "p_brand AS tenor", "s_name AS category_code", "l_quantity AS coupon_percent")


@query("SELECT o_orderkey AS issue_id, o_orderstatus AS status, m AS first_page FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def terms_first_page(spark, sf):
    t = Tables(spark, sf)
    return search.first_page(t.orders.selectExpr("o_orderkey AS issue_id", "o_orderstatus AS status"), t.lineitem.selectExpr("l_orderkey AS issue_id", "l_linenumber"), "issue_id", "l_linenumber")


@query("""
SELECT o_orderkey AS issue_id, n_name AS issuer, c_name AS document_name, coalesce(r, '') AS ratings
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def issue_overview(spark, sf):
    t = Tables(spark, sf)
    base = search.star(t.orders, [(search.small(t.customer), F.col("o_custkey") == F.col("c_custkey")), (search.small(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))])
    full = search.attached(base.withColumn("l_orderkey", F.col("o_orderkey")), t.lineitem, "l_orderkey", ["l_linenumber", "l_returnflag"], "ratings")
    shown = F.array_join(F.transform("ratings", lambda r: F.concat(r["l_linenumber"].cast("string"), F.lit(":"), r["l_returnflag"])), ",")
    return full.select(F.col("o_orderkey").alias("issue_id"), F.col("n_name").alias("issuer"), F.col("c_name").alias("document_name"), shown.alias("ratings"))


@query("SELECT count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part WHERE p_name LIKE '%a_e%'")
def like_wildcard(spark, sf):
    return search.matching(Tables(spark, sf).part, like={"p_name": "a_e"}).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").cast("long").alias("sizes"))


@query("""
SELECT l_orderkey, l_linenumber, concat_ws(', ', 'quantity ' || l_quantity::BIGINT, CASE WHEN l_returnflag <> 'N' THEN 'flag ' || l_returnflag END) || '.' AS text FROM lineitem""")
def row_sentence(spark, sf):
    parts = {"quantity": F.col("l_quantity").cast("long"), "flag": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))}
    return Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", search.sentence(parts).alias("text"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' AND p_type LIKE '%AN_%'")
def match_exact(spark, sf):
    return search.matching(Tables(spark, sf).part, {"p_brand": "Brand#13"}, {"p_type": "AN_"}).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#13' AND lower(p_type) LIKE '%an_%'")
def match_any_case(spark, sf):
    return search.matching(Tables(spark, sf).part, {"p_brand": "BRAND#13"}, {"p_type": "An_"}, "UTF8_LCASE").select("p_partkey")


# --- graph ----------------------------------------------------------------------------------------------------


@query("""
SELECT n_name AS issuer,
 (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_nationkey = n_nationkey)) AS segments,
 (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT s_name AS v FROM supplier WHERE s_nationkey = n_nationkey)) AS managers FROM nation""")
def issuer_neighborhood(spark, sf):
    t = Tables(spark, sf)
    legs = {"segments": t.customer.selectExpr("c_nationkey AS n_nationkey", "c_mktsegment AS value"), "managers": t.supplier.selectExpr("s_nationkey AS n_nationkey", "s_name AS value")}
    out = graph.neighbourhood(t.nation, "n_nationkey", legs)
    shown = lambda c: F.nullif(F.array_join(c, ","), F.lit("")).alias(c)
    return out.select(F.col("n_name").alias("issuer"), shown("segments"), shown("managers"))


def _branches(t: Tables) -> dict[str, DataFrame]:
    nation = search.small(t.nation.selectExpr("n_nationkey", "n_name AS issuer"))
    return {
        "DebentureTrustee": t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("issuer", "s_name AS participant"),
        "LeadManager": t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("issuer", "c_name AS participant"),
    }


_PARTICIPANTS = "SELECT DISTINCT n_name AS issuer, {0}_name AS participant, '{2}' AS role FROM {1} JOIN nation ON {0}_nationkey = n_nationkey WHERE lower({0}_name) LIKE '%00001%'"


@query(_PARTICIPANTS.format("s", "supplier", "DebentureTrustee") + " UNION " + _PARTICIPANTS.format("c", "customer", "LeadManager"))
def participant_any(spark, sf):
    return graph.participants(_branches(Tables(spark, sf)), "00001")


@query(_PARTICIPANTS.format("s", "supplier", "DebentureTrustee"))
def participant_trustee(spark, sf):
    return graph.participants(_branches(Tables(spark, sf)), "00001", "DebentureTrustee")


@query("SELECT l_orderkey, l_returnflag, arg_max(l_linestatus, l_linenumber * 2 + (l_linestatus = 'O')::INT) AS outlook FROM lineitem GROUP BY 1, 2")
def last_rating_edge(spark, sf):
    return graph.last_rating(Tables(spark, sf).lineitem.withColumn("seq", F.expr("l_linenumber * 2 + int(l_linestatus = 'O')")), ["l_orderkey", "l_returnflag"], "seq", ["l_linestatus"]).withColumnRenamed("l_linestatus", "outlook")


_EDGES = "SELECT 's' || s_suppkey AS source, 'n' || s_nationkey AS target FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT 'n' || c_nationkey, c_mktsegment FROM customer UNION SELECT c_mktsegment, 'n' || c_nationkey FROM customer WHERE c_acctbal < 0"


def _reach(spark, sf, depth):
    t, name = Tables(spark, sf), lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    ends = lambda df, a, b: df.select(a.alias("source"), b.alias("target"))
    nation, region, segment = name("n", "n_nationkey"), name("r", "n_regionkey"), F.col("c_mktsegment")
    edges = ends(t.supplier, name("s", "s_suppkey"), name("n", "s_nationkey")).union(ends(t.nation, nation, region)).union(ends(t.nation, region, nation))
    edges = edges.union(ends(t.customer, name("n", "c_nationkey"), segment)).union(ends(t.customer.filter("c_acctbal < 0"), segment, name("n", "c_nationkey")))
    return graph.reached(t.supplier.select(name("s", "s_suppkey").alias("node")), edges, depth)


for _depth in (1, 2, 3, 4):
    QUERIES[f"neighborhood_depth_{_depth}"] = lambda spark, sf, depth=_depth: _reach(spark, sf, depth)
    ORACLE_SQL[f"neighborhood_depth_{_depth}"] = f"""WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS node, 0 AS depth FROM supplier UNION SELECT w.start, e.target, w.depth + 1 FROM w JOIN e ON e.source = w.node WHERE w.depth < {_depth})
SELECT start, node, min(depth) AS depth FROM w WHERE start IS NOT NULL AND node IS NOT NULL GROUP BY 1, 2"""


# --- free SQL -------------------------------------------------------------------------------------------------

_FREE = {
    "free_sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "free_sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "free_sql_window": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders",
    "free_sql_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10) SELECT c_mktsegment, count(*) AS customers, cast(sum(n) AS BIGINT) AS orders_n FROM big JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "free_sql_setops": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
}


def _free(statement: str):
    def run(spark, sf):
        from ledgerlark.plans.tools import guarded

        for name in ("lineitem", "orders", "customer", "part", "supplier", "nation"):
            Tables(spark, sf).__getattr__(name).createOrReplaceTempView(name)
        return guarded(spark, statement)

    return run


for _name, _statement in _FREE.items():
    QUERIES[_name], ORACLE_SQL[_name] = _free(_statement), _statement


# --- text functions -------------------------------------------------------------------------------------------

_WS = r"'\s+', ' ', 'g'"


@query(rf"SELECT doc_id, trim(regexp_replace(text, {_WS})) AS flat FROM documents")
def normalize_text(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", text.collapsed(F.col("text")).alias("flat"))


@query(r"SELECT p_partkey, regexp_replace(lower(trim(p_name || ' (Series A) ', ' ')), '\s*\([^)]*\)\s*$', '') AS k, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def normalize_entity(spark, sf):
    return Tables(spark, sf).part.select("p_partkey", text.entity_key(F.concat("p_name", F.lit(" (Series A) "))).alias("k"), text.slug(F.col("p_name")).alias("slug"))


@query(r"SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1')), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'document') AS id FROM pages")
def make_document_id(spark, sf):
    return Tables(spark, sf).pages.select("page_id", text.document_id(F.col("url")).alias("id"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Zero Coupon' WHEN 1 THEN 'Cumulative' WHEN 2 THEN 'Coupon-Bearing' END AS kind FROM orders")
def coupon_type(spark, sf):
    label = F.element_at(F.array(F.lit("a Zero coupon bond"), F.lit("CUMULATIVE"), F.lit("Annual"), F.lit(None)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return Tables(spark, sf).orders.select("o_orderkey", text.coupon_type(label).alias("kind"))


_LABELS = ["Coupon for Category IV", "Price (% p.a.) for NCD Holders in Category I, II, III & IV", "Cat. ii and i", "Tenor"]
_CATEGORIES = "CASE o_orderkey % 4 WHEN 0 THEN 'IV' WHEN 1 THEN 'I_II_III_IV' WHEN 2 THEN 'I_II' END"


def _label(t: Tables) -> DataFrame:
    return t.orders.withColumn("label", F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("o_orderkey") % 4 + 1).cast("int")))


@query(f"SELECT o_orderkey, {_CATEGORIES} AS category FROM orders")
def extract_category(spark, sf):
    return _label(Tables(spark, sf)).select("o_orderkey", text.category_in_label(F.col("label")).alias("category"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Category IV' WHEN 1 THEN 'Category I, II, III and IV' WHEN 2 THEN 'Category I and Category II' END AS name FROM orders")
def category_name(spark, sf):
    return _label(Tables(spark, sf)).select("o_orderkey", text.category_name(text.category_in_label(F.col("label"))).alias("name"))


@query(f"SELECT o_orderkey, unnest(string_split({_CATEGORIES}, '_')) AS category_code FROM orders WHERE o_orderkey % 4 <> 3")
def explode_categories(spark, sf):
    rows = _label(Tables(spark, sf)).withColumn("category_id", text.category_in_label(F.col("label")))
    return load.exploded_categories(rows, "category_id").select("o_orderkey", "category_code")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 12) + 0.5 END::DOUBLE AS pct, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE floor(o_totalprice) END::DOUBLE AS amt FROM orders""")
def clean_numbers(spark, sf):
    pct = F.when(F.col("o_orderkey") % 5 == 0, "N.A.").otherwise(F.concat(F.lit("p.a. "), (F.col("o_orderkey") % 12).cast("string"), F.lit(".5 %")))
    amt = F.when(F.col("o_orderkey") % 5 == 0, " - ").otherwise(F.concat(F.lit("₹ "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" Rs.")))
    return Tables(spark, sf).orders.select("o_orderkey", text.percentage(pct).alias("pct"), text.amount(amt).alias("amt"))


@query("SELECT o_orderkey, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 16))::UBIGINT::VARCHAR AS point FROM orders")
def point_id(spark, sf):
    return Tables(spark, sf).orders.select("o_orderkey", text.point_id(F.col("o_orderkey").cast("string")).cast("string").alias("point"))


@query(r"SELECT doc_id, regexp_replace(replace(substr(text, 1, 150), chr(10), ' '), '^\s+|\s+$', '', 'g') AS preview, concat_ws(' — ', source, CASE WHEN doc_id % 7 <> 0 THEN 'p.' || (doc_id % 7) END, lang) AS label FROM documents")
def chunk_payload(spark, sf):
    label = text.chunk_label(F.col("source"), F.col("doc_id") % 7, F.col("lang"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return Tables(spark, sf).documents.select("doc_id", text.preview(F.col("text")).alias("preview"), label.alias("label"))


# --- page facts -----------------------------------------------------------------------------------------------

_PAGE = """WITH page AS (SELECT o_orderkey, concat('The NCDs aggregate within the Shelf Limit of ₹', floor(o_totalprice)::BIGINT, ' crore',
 CASE o_orderkey % 3 WHEN 0 THEN ' with a Green Shoe Option of Rs. ' || o_custkey || ' million' WHEN 1 THEN ' and ₹ ' || o_custkey || ' CRORE ("Green Shoe Option")' ELSE '' END,
 '. Coupon of ', o_orderkey % 12, '.5 % and ISIN INE', lpad((o_orderkey % 100000)::VARCHAR, 6, '0'), 'AB7 x. Base Issue Size: Rs. ', o_custkey, ' lakh, face value of ₹ ', o_orderkey % 10, ',000',
 ', Minimum Security Cover of ', o_orderkey % 3, '.25 %. Issue Opens on Monday, March ', 1 + o_orderkey % 28, ', 2024 and Issue Closes on: April ', 1 + o_custkey % 28, ' 2024 under this Tranche II Prospectus dated May 3, 2024; TRANCHE ii ISSUE.') AS t FROM orders) """


def _pages(t: Tables) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    shoe = F.when(key % 3 == 0, F.concat(F.lit(" with a Green Shoe Option of Rs. "), cust, F.lit(" million"))).when(key % 3 == 1, F.concat(F.lit(" and ₹ "), cust, F.lit(' CRORE ("Green Shoe Option")'))).otherwise("")
    n = lambda m, plus=0: (key % m + plus).cast("string")
    t_ = F.concat(
        F.lit("The NCDs aggregate within the Shelf Limit of ₹"), F.floor("o_totalprice").cast("string"), F.lit(" crore"), shoe, F.lit(". Coupon of "), n(12), F.lit(".5 % and ISIN INE"), F.lpad(n(100000), 6, "0"),
        F.lit("AB7 x. Base Issue Size: Rs. "), cust, F.lit(" lakh, face value of ₹ "), n(10), F.lit(",000, Minimum Security Cover of "), n(3), F.lit(".25 %. Issue Opens on Monday, March "), n(28, 1),
        F.lit(", 2024 and Issue Closes on: April "), (F.col("o_custkey") % 28 + 1).cast("string"), F.lit(" 2024 under this Tranche II Prospectus dated May 3, 2024; TRANCHE ii ISSUE."),
    )
    return t.orders.select("o_orderkey", t_.alias("t"))


_MONEY = r"(?:₹|Rs\.?|INR)\s*[\d,]+(?:\.\d+)?\s*(?:crore|lakh|million|billion)?"
_FACTS = {
    "shelf_limit": (extract.shelf_limit, rf"trim(regexp_extract(t, '(?i)Shelf\s+Limit\s*(?:of)?\s*({_MONEY})', 1))"),
    "green_shoe": (extract.green_shoe_option, rf"""nullif(trim(coalesce(nullif(regexp_extract(t, '(?i)Green\s+Shoe\s+Option\s*(?:of)?\s*({_MONEY})', 1), ''), regexp_extract(t, '(?i)({_MONEY})\s*\(["]\s*Green\s+Shoe\s+Option\s*["]\)', 1))), '')"""),
    "base_issue_size": (extract.base_issue_size, rf"trim(regexp_extract(t, '(?i)Base Issue Size\s*(?:[:\-]\s*)?({_MONEY})', 1))"),
    "face_value": (extract.face_value, r"regexp_extract(t, '(?i)face value\s*(?:of|:)?\s*(₹?\s*[\d,]+)', 1)"),
    "coupon": (extract.coupon, r"regexp_extract(t, '(?i)(?:Coupon|Interest Rate)[^%]{0,100}?(\d+(?:\.\d+)?\s*%)', 1)"),
    "security_cover": (extract.security_cover, r"regexp_extract(t, '(?i)(?:Minimum\s+)?Security Cover.{0,150}?(\d+(?:\.\d+)?\s*%)', 1)"),
    "isin": (lambda c: F.array_join(extract.isins(c), ","), r"array_to_string(regexp_extract_all(t, '\b([A-Z]{2}[A-Z0-9]{9}[0-9])\b', 1), ',')"),
    "open_date": (extract.open_date, r"regexp_extract(t, '(?i)Issue\s+Opens?\s+on\s*:?\s*((?:Monday,?\s+)?(?:March|April|May)\s+\d{1,2},?\s*\d{4})', 1)"),
    "close_date": (extract.close_date, r"regexp_extract(t, '(?i)Issue\s+Closes?\s+on\s*:?\s*((?:Monday,?\s+)?(?:March|April|May)\s+\d{1,2},?\s*\d{4})', 1)"),
    "document_date": (extract.document_date, r"regexp_extract(t, '(?i)this\s+(?:tranche\s+[ivxlcdm]+\s+)?prospectus\s+dated\s+((?:March|April|May)\s+\d{1,2},?\s*\d{4})', 1)"),
    "issue_name": (extract.issue_name, r"'Tranche ' || upper(regexp_extract(t, '(?i)TRANCHE\s+([IVXLCDM]+)\s+ISSUE\b', 1)) || ' Issue'"),
}


def _fact(function):
    return lambda spark, sf: _pages(Tables(spark, sf)).select("o_orderkey", function(F.col("t")).alias("fact"))


for _name, (_function, _sql) in _FACTS.items():
    QUERIES[_name], ORACLE_SQL[_name] = _fact(_function), f"{_PAGE} SELECT o_orderkey, {_sql} AS fact FROM page"


@query("SELECT o_orderkey, 'BSE Limited' AS exchange, 'BSE' AS exchange_alias, 'CRISIL AAA/Stable' AS rating, 'Stable' AS outlook FROM orders")
def listing_and_grade(spark, sf):
    page = F.concat(F.lit('proposed to be listed on the BSE  Limited ("BSE") and have been rated “CRISIL AAA/Stable” (pronounced x) for issue '), F.col("o_orderkey").cast("string"))
    rows = Tables(spark, sf).orders.select("o_orderkey", extract.listing(page).alias("l"), extract.grade_parts(F.get(extract.rating_grades(page), F.lit(0))).alias("g"))
    return rows.select("o_orderkey", F.col("l.exchange").alias("exchange"), F.col("l.exchange_alias").alias("exchange_alias"), F.col("g.rating").alias("rating"), F.col("g.outlook").alias("outlook"))


@query("SELECT o_orderkey, 'CARE Ratings Limited' AS agency, 'CARE AA+; Stable' AS rating, 'Stable' AS outlook, 'June 3, 2024' AS rating_date FROM orders WHERE o_orderkey % 2 = 0")
def rating_letters(spark, sf):
    letter = F.when(F.col("o_orderkey") % 2 == 0, "The credit rating letter dated June 3, 2024 issued by CARE Ratings Limited assigning a rating of “CARE AA+; Stable” to the NCDs").otherwise("no letter")
    return Tables(spark, sf).orders.select("o_orderkey", F.inline(names.rating_letters_in(letter))).select("o_orderkey", "agency", "rating", "outlook", "rating_date")


@query("SELECT o_orderkey, unnest(['Debenture Trustee', 'Lead Manager']) AS entity_type, unnest(['Beacon Trusteeship Limited', 'Nuvama Wealth Management Limited']) AS value FROM orders")
def labeled_entities(spark, sf):
    page = F.concat(F.lit("the Debenture Trustee Beacon Trusteeship Limited with its office in Mumbai. It is further noted that the proceeds are kept apart until listing approval is received for issue "), F.col("o_orderkey").cast("string"), F.lit(" whose Lead Managers are Nuvama Wealth Management Limited and nobody else"))
    return Tables(spark, sf).orders.select("o_orderkey", F.inline(names.labelled_names_in(page)))


@query("""SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'A. K. Capital Services Limited' WHEN 1 THEN 'Alpha Beta Private Limited' WHEN 2 THEN 'Gamma Corp and Delta Trust LLP'
 WHEN 3 THEN 'Desk ' || o_orderkey || ' Holdings Ltd' END AS name FROM orders WHERE o_custkey % 5 < 4""")
def company_names(spark, sf):
    key = F.col("o_orderkey").cast("string")
    pages = [
        F.concat(F.lit("arranged by A. K. Capital Services Limited for order "), key), F.concat(F.lit("order "), key, F.lit(" was signed with Alpha Beta Private Limited.")),
        F.lit("a report of Gamma Corp and Delta Trust LLP, dated"), F.concat(F.lit("with (“ by Desk "), key, F.lit(" Holdings Ltd.;")),
    ]
    page = F.lit("the Company Limited, to the Limited extent; Services Limited")
    for k, p in enumerate(pages):
        page = F.when(F.col("o_custkey") % 5 == k, p).otherwise(page)
    return Tables(spark, sf).orders.select("o_orderkey", F.inline(names.company_names_in(page))).select("o_orderkey", "name")


@query()
def toc_similarity(spark, sf):
    part = Tables(spark, sf).part
    return part.select("p_partkey", F.round(names.similarity_of("p_name", "p_type"), 3).alias("similarity"))


# --- votes, boundaries, geometry ------------------------------------------------------------------------------


@query("SELECT p_brand, p_size, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, seen) AS r FROM (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS seen FROM part GROUP BY 1, 2)) WHERE r = 1")
def body_size_mode(spark, sf):
    return intervals.most_common(Tables(spark, sf).part, ["p_brand"], "p_size", "p_partkey")


_VOTE = "SELECT {k}, o AS {n} FROM (SELECT {k}, o, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, min(l_orderkey * 8 + l_linenumber)) AS r FROM {t} GROUP BY {k}, o) WHERE r = 1"


@query("WITH v AS (SELECT l_suppkey, (l_quantity::BIGINT - 30) AS o, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity::BIGINT - 30 BETWEEN -20 AND 20), a AS (" + _VOTE.format(k="l_suppkey", n="f", t="v") + "), w AS (SELECT v.* FROM v JOIN a USING (l_suppkey) WHERE abs(v.o - a.f) <= 10), b AS (" + _VOTE.format(k="l_suppkey", n="s", t="w") + ") SELECT l_suppkey, CASE WHEN coalesce(s, 0) <> 0 THEN s ELSE f END AS page_offset FROM a LEFT JOIN b USING (l_suppkey)")
def page_offset_vote(spark, sf):
    rows = Tables(spark, sf).lineitem.select("l_suppkey", (F.col("l_quantity").cast("long") - 30).alias("o"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return intervals.offset_vote(rows, ["l_suppkey"], "o", "seq").withColumnRenamed("offset", "page_offset")


def _sections(t: Tables) -> DataFrame:
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    numbered = t.orders.withColumn("seq", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return numbered.select("o_custkey", "seq", level.alias("level"), (F.col("seq") * 2).alias("start_page"), F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("title"))


_SECTIONS = "WITH s AS (SELECT o_custkey, seq, level, seq * 2 AS start_page, title FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, substr(o_orderpriority, 1, 1)::INT AS level, 'S' || o_orderkey AS title FROM orders)), e AS (SELECT s.*, CASE WHEN (SELECT min(n.seq) FROM s n WHERE n.o_custkey = s.o_custkey AND n.seq > s.seq AND n.level <= s.level) IS NULL THEN 500 ELSE greatest(start_page, (SELECT min(n.seq) FROM s n WHERE n.o_custkey = s.o_custkey AND n.seq > s.seq AND n.level <= s.level) * 2 - 1) END AS end_page FROM s) "


@query(_SECTIONS + "SELECT o_custkey, seq::INT AS seq, end_page::INT AS end_page FROM e")
def section_bounds(spark, sf):
    return intervals.section_ends(_sections(Tables(spark, sf)), "o_custkey", "seq", "level", "start_page", F.lit(500)).select("o_custkey", "seq", "end_page")


@query(_SECTIONS + "SELECT o_custkey, seq::INT AS seq, CASE WHEN lead(start_page) OVER (PARTITION BY o_custkey ORDER BY seq) IS NULL THEN 500 ELSE greatest(start_page, lead(start_page) OVER (PARTITION BY o_custkey ORDER BY seq) - 1) END::INT AS end_page FROM s")
def layout_bounds(spark, sf):
    return intervals.layout_ends(_sections(Tables(spark, sf)), "o_custkey", "seq", "start_page", F.lit(500)).select("o_custkey", "seq", "end_page")


@query(_SECTIONS + "SELECT o_custkey, seq::INT AS seq FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.o_custkey = a.o_custkey AND b.seq <> a.seq AND b.level > a.level AND b.start_page BETWEEN a.start_page AND a.end_page)")
def leaf_sections(spark, sf):
    ended = intervals.section_ends(_sections(Tables(spark, sf)), "o_custkey", "seq", "level", "start_page", F.lit(500))
    return intervals.leaves(ended, "o_custkey", "seq", "level").select("o_custkey", "seq")


@query(_SECTIONS + "SELECT a.o_custkey, a.seq::INT AS seq, (SELECT string_agg(b.title, ' > ' ORDER BY b.seq) FROM s b WHERE b.o_custkey = a.o_custkey AND b.seq <= a.seq AND NOT EXISTS (SELECT 1 FROM s c WHERE c.o_custkey = b.o_custkey AND c.seq > b.seq AND c.seq <= a.seq AND c.level <= b.level)) AS path FROM s a")
def section_path(spark, sf):
    return intervals.section_paths(_sections(Tables(spark, sf)), "o_custkey", "seq", "level", "title").select("o_custkey", "seq", F.array_join("path", " > ").alias("path"))


@query("""WITH x AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 1000 * (event_id % 50) AS b FROM events),
y AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
z AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM y)
SELECT user_id, min(a) AS a, max(b) AS b FROM z GROUP BY user_id, island""")
def interval_union(spark, sf):
    spans = Tables(spark, sf).events.select("user_id", F.unix_timestamp("ts").alias("a"), (F.unix_timestamp("ts") + 1000 * (F.col("event_id") % 50)).alias("b"))
    return intervals.merged_spans(spans, ["user_id"], "a", "b")


@query("""WITH n AS (SELECT row_number() OVER () AS u, l_orderkey AS k, l_linenumber * 100000000 + l_partkey AS name_id, round(l_quantity)::BIGINT * 10 AS c FROM lineitem), l AS (SELECT l_orderkey AS k, l_linenumber * 100000000 + l_partkey AS o, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS ty, round(l_discount * 100)::BIGINT * 50 AS m FROM lineitem),
p AS (SELECT k, name_id, ty, abs(c - m) AS d, row_number() OVER (PARTITION BY u ORDER BY CASE WHEN m <= c THEN abs(c - m) * 15 ELSE abs(c - m) * 100 END, o, ty NULLS FIRST, abs(c - m)) AS r FROM n JOIN l USING (k))
SELECT k, name_id, ty AS label_type, d::DOUBLE AS distance FROM p WHERE r = 1 AND ty IS NOT NULL AND d <= 180""")
def nearest_label(spark, sf):
    item = Tables(spark, sf).lineitem
    found = intervals.nearest_label(
        item.selectExpr("l_orderkey AS k", "l_linenumber * 100000000L + l_partkey AS name_id", "round(l_quantity) * 10 AS centre"),
        item.selectExpr("l_orderkey AS k", "l_linenumber * 100000000L + l_partkey AS label_order", "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS label_type", "round(l_discount * 100) * 50 AS midpoint"), "k")
    return found.withColumn("distance", F.round("distance", 6))


@query("SELECT a.l_orderkey, a.l_linenumber AS cell, b.l_linenumber AS series FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity BETWEEN b.l_quantity - 5 AND b.l_quantity + 5")
def cell_series_match(spark, sf):
    item = Tables(spark, sf).lineitem
    points, ranges = item.selectExpr("l_orderkey", "l_linenumber AS cell", "l_quantity AS at"), item.selectExpr("l_orderkey", "l_linenumber AS series", "l_quantity - 5 AS low", "l_quantity + 5 AS high")
    return intervals.cells_in_ranges(points, ranges, "l_orderkey", F.col("at"), F.col("low"), F.col("high")).select("l_orderkey", "cell", "series")


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 AND count(o_orderstatus) = count(*) THEN min(o_orderstatus) END AS o_orderstatus, CASE WHEN count(DISTINCT o_orderpriority) = 1 AND count(o_orderpriority) = count(*) THEN min(o_orderpriority) END AS o_orderpriority FROM orders GROUP BY 1")
def hoist_shared(spark, sf):
    return intervals.hoisted(Tables(spark, sf).orders, "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT l_orderkey, string_agg(p::VARCHAR, ',' ORDER BY p) AS pages FROM (SELECT DISTINCT l_orderkey, unnest([l_linenumber, l_linenumber + 1]) AS p FROM lineitem) GROUP BY 1")
def series_merge_pages(spark, sf):
    rows = Tables(spark, sf).lineitem.select("l_orderkey", F.array("l_linenumber", F.col("l_linenumber") + 1).alias("pages"))
    return intervals.merged_lists(rows, "l_orderkey", "pages").select("l_orderkey", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


# --- loading --------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' OR o_orderpriority = '1-URGENT' THEN CASE WHEN o_custkey % 3 <> 0 THEN lower(o_orderstatus) END ELSE o_orderstatus END AS status FROM orders")
def upsert_issues(spark, sf):
    o = Tables(spark, sf).orders
    old = o.filter("o_orderpriority <> '1-URGENT'").selectExpr("o_orderkey", "o_orderstatus AS status")
    new = o.filter("o_orderstatus = 'O' OR o_orderpriority = '1-URGENT'").selectExpr("o_orderkey", "CASE WHEN o_custkey % 3 <> 0 THEN lower(o_orderstatus) END AS status")
    return load.upserted(old, new, ["o_orderkey"], ["status"])


@query("SELECT l_orderkey, l_returnflag, min(l_linenumber) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2 UNION ALL SELECT l_orderkey, l_returnflag, min(l_linenumber) FROM lineitem a WHERE l_linenumber > 2 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = a.l_returnflag AND b.l_linenumber <= 2) GROUP BY 1, 2")
def insert_if_absent(spark, sf):
    item = Tables(spark, sf).lineitem.selectExpr("l_orderkey", "l_returnflag", "l_linenumber AS n")
    old = item.filter("n <= 2").groupBy("l_orderkey", "l_returnflag").agg(F.min("n").alias("n"))
    return load.inserted_if_absent(old, item.filter("n > 2"), ["l_orderkey", "l_returnflag"])


@query("SELECT 'I' AS category_code, 'Category I (seed)' AS category_name UNION SELECT DISTINCT l_returnflag, 'Category ' || l_returnflag FROM lineitem")
def category_get_or_create(spark, sf):
    seed = spark.createDataFrame([("I", "Category I (seed)")], "category_code string, category_name string")
    return load.categories(seed, Tables(spark, sf).lineitem.selectExpr("l_returnflag AS category_code").union(seed.select("category_code")))


@query("SELECT DISTINCT l_orderkey, l_linenumber AS page_number, unnest(['series', 'l_tax']) AS source_field FROM lineitem WHERE l_returnflag <> 'N' UNION SELECT l_orderkey, l_linenumber, 'l_tax' FROM lineitem UNION SELECT l_orderkey, l_linenumber, 'series' FROM lineitem UNION SELECT l_orderkey, l_linenumber, 'flag' FROM lineitem WHERE l_returnflag <> 'N'")
def provenance_rows(spark, sf):
    rows = Tables(spark, sf).lineitem.withColumn("flag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    return load.provenance_rows(rows, "l_orderkey", "l_linenumber", ["l_tax", "flag"])


# --- vectors, chunks ------------------------------------------------------------------------------------------

_COSINE = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


def _probe(t: Tables) -> list[float]:
    return t.embeddings.filter("vec_id = 0").first()["embedding"]


def _shown(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_COSINE} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 8)")
def vector_topk(spark, sf):
    t = Tables(spark, sf)
    return _shown(vector.top_k(t.embeddings, _probe(t)))


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_COSINE} AS s FROM embeddings WHERE label = 3 ORDER BY s DESC, vec_id LIMIT 8)")
def vector_filtered(spark, sf):
    t = Tables(spark, sf)
    return _shown(vector.top_k(t.embeddings, _probe(t), filters={"label": 3, "source": None}))


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_COSINE} AS s FROM embeddings) WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 200")
def vector_threshold(spark, sf):
    t = Tables(spark, sf)
    return _shown(vector.top_k(t.embeddings, _probe(t), k=1000, threshold=0.2))


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, label, {_COSINE} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 50) WHERE label = 3")
def vector_postfilter(spark, sf):
    t = Tables(spark, sf)
    return _shown(vector.top_k(t.embeddings, _probe(t), k=50).filter("label = 3"))


@query("SELECT query_id, vec_id, r AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE r <= 4")
def vector_topk_twentieth(spark, sf):
    """Every row whose id is divisible by 20 asks all rows."""
    e = Tables(spark, sf).embeddings
    found = vector.top_k_of_each(e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e, 4)
    return found.select("query_id", F.col("key").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, trim(text, E' \n\t\r') AS t FROM documents),
w AS (SELECT doc_id, t, 1 AS n, 0 AS s, CASE WHEN length(t) <= 3500 THEN length(t) ELSE 3500 END AS want FROM d WHERE length(t) > 0),
p AS (SELECT doc_id, t, n, s, CASE WHEN want < length(t) AND length(regexp_extract(substr(t, s + 1, want - s), '^(?s:.*)[\n ]')) - 1 + s > s + 500 THEN s + length(regexp_extract(substr(t, s + 1, want - s), '^(?s:.*)[\n ]')) - 1 ELSE want END AS e FROM w
 UNION ALL SELECT doc_id, t, n + 1, s2, CASE WHEN want < length(t) AND length(regexp_extract(substr(t, s2 + 1, want - s2), '^(?s:.*)[\n ]')) - 1 > 500 THEN s2 + length(regexp_extract(substr(t, s2 + 1, want - s2), '^(?s:.*)[\n ]')) - 1 ELSE want END
 FROM (SELECT doc_id, t, n, CASE WHEN e - 300 > s THEN e - 300 ELSE e END AS s2, least(CASE WHEN e - 300 > s THEN e - 300 ELSE e END + 3500, length(t)) AS want FROM p WHERE e < length(t)))
SELECT doc_id, n::INT AS piece, length(trim(substr(t, s + 1, e - s), E' \n\t\r'))::INT AS n_chars FROM p""")
def split_text(spark, sf):
    pieces = Tables(spark, sf).documents.select("doc_id", F.posexplode(chunking.split_texts("text")).alias("i", "piece"))
    return pieces.select("doc_id", (F.col("i") + 1).alias("piece"), F.char_length("piece").alias("n_chars"))


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id, length(text), text) AS r FROM documents WHERE length(text) > 0),
p AS (SELECT source, doc_id, n, r, n AS held, 1 AS chunk_id FROM d WHERE r = 1
 UNION ALL SELECT d.source, d.doc_id, d.n, d.r, CASE WHEN p.held + d.n > 3500 THEN d.n ELSE p.held + d.n END, p.chunk_id + (p.held + d.n > 3500)::INT FROM p JOIN d ON d.source IS NOT DISTINCT FROM p.source AND d.r = p.r + 1)
SELECT source, chunk_id, min(doc_id) AS start_page, max(doc_id) AS end_page, (sum(n) + 2 * (count(*) - 1))::INT AS n_chars FROM p GROUP BY 1, 2""")
def page_windows(spark, sf):
    return chunking.page_windows(Tables(spark, sf).documents, "source", "doc_id", "text").select("source", "chunk_id", "start_page", "end_page", F.char_length("text").alias("n_chars"))


@query()
def section_chunks(spark, sf):
    docs = Tables(spark, sf).documents
    pages = docs.select(F.col("source").alias("document"), F.col("doc_id").cast("int").alias("page"), "text")
    ends = docs.groupBy(F.col("source").alias("document")).agg(F.min("doc_id").cast("int").alias("start_page"), F.max("doc_id").cast("int").alias("end_page"))
    sections = ends.select("document", F.lit(1).alias("section_no"), "start_page", "end_page", F.array(F.lit("Terms"), F.col("document")).alias("path"))
    excluded = pages.filter(F.char_length("text") < 200).select("document", "page")
    return chunking.chunks_of_sections(sections, pages, excluded).select("chunk_id", "document", "start_page", "end_page", "section", "subsection", "char_count")


# --- tables, entities, retrieval ------------------------------------------------------------------------------

_ROUTED = ["Tenor (months)", "Coupon (% p.a.) for Category II", "Amount on Maturity, Category I & II", "Put and call option", "Nature of Indebtedness", "Notes"]


@query("""
SELECT o_orderkey, CASE k WHEN 0 THEN 'tenor' WHEN 1 THEN 'coupon' WHEN 2 THEN 'maturity_amount' WHEN 3 THEN 'put_call_option' ELSE 'nature_of_indebtedness' END AS field, CASE k WHEN 1 THEN 'II' WHEN 2 THEN 'I_II' END AS category,
 CASE WHEN k IN (0, 3, 4) THEN o_custkey || ' %' END AS value_text, CASE WHEN k IN (1, 2) THEN o_custkey::DOUBLE END AS value_num FROM (SELECT *, o_orderkey % 6 AS k FROM orders) WHERE k <> 5""")
def route_field(spark, sf):
    label = F.element_at(F.array(*map(F.lit, _ROUTED)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = Tables(spark, sf).orders.select("o_orderkey", label.alias("label"), F.concat(F.col("o_custkey").cast("string"), F.lit(" %")).alias("value"))
    return tables.routed(rows).select("o_orderkey", "field", "category", "value_text", "value_num")


@query("SELECT a.l_orderkey, a.l_linenumber AS cell, b.l_linenumber AS line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_quantity >= a.l_quantity - a.l_linenumber AND b.l_quantity <= a.l_quantity + a.l_linenumber")
def cell_row_match(spark, sf):
    item = Tables(spark, sf).lineitem
    cells = item.selectExpr("l_orderkey", "l_linenumber AS cell", "l_quantity - l_linenumber AS top", "l_quantity + l_linenumber AS bottom")
    return intervals.cells_in_ranges(item.selectExpr("l_orderkey", "l_linenumber AS line", "l_quantity AS middle"), cells, "l_orderkey", F.col("middle"), F.col("top"), F.col("bottom")).select("l_orderkey", "cell", "line")


@query("SELECT p_partkey FROM part JOIN (SELECT p_brand AS b, p_size AS m FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey)) AS r FROM part GROUP BY 1, 2) WHERE r = 1) ON b = p_brand WHERE length(trim(p_name)) BETWEEN 3 AND 180 AND (p_size >= m + 1.5 OR p_partkey % 7 = 0) AND p_partkey % 100 >= 8 AND p_partkey % 100 + 1 <= 92")
def heading_candidates(spark, sf):
    part = Tables(spark, sf).part
    body = intervals.most_common(part, ["p_brand"], "p_size", "p_partkey").selectExpr("p_brand AS document", "p_size AS body_size")
    lines = part.selectExpr("p_partkey", "p_brand AS document", "p_name AS text", "p_size AS size", "p_partkey % 7 = 0 AS bold", "array(0D, double(p_partkey % 100), 1D, double(p_partkey % 100 + 1)) AS bbox", "100D AS page_height")
    return structure.headings(lines, body).select("p_partkey")


@query("SELECT event_type AS entity_type, 'user ' || user_id AS key, 'User  ' || user_id AS value, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS mentions FROM events GROUP BY 1, 2, 3")
def entity_group(spark, sf):
    value = F.concat(F.lit("User  "), F.col("user_id").cast("string"))
    found = Tables(spark, sf).events.select(F.date_format("ts", "yyyy-MM-dd").alias("chunk_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("entity_type"), value.alias("value"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"))
    return entities.grouped(found).select("entity_type", "key", "value", F.size("mentions").cast("long").alias("mentions"))


@query("""
WITH f AS (SELECT o_custkey AS document, o_orderkey AS chunk, CASE o_orderpriority WHEN '1-URGENT' THEN 'Issuer' WHEN '2-HIGH' THEN 'Debenture Trustee' ELSE 'ISIN' END AS t, 'v' || (o_orderkey % 5) AS v FROM orders),
n AS (SELECT document, t, v, count(DISTINCT chunk) AS n FROM f GROUP BY 1, 2, 3),
c AS (SELECT document, t, v, row_number() OVER (PARTITION BY document, t ORDER BY n DESC, length(v), v) AS r FROM n)
SELECT f.document, 'issuer:' || i.v AS subject, CASE f.t WHEN 'ISIN' THEN 'HAS_ISIN' ELSE 'HAS_DEBENTURE_TRUSTEE' END AS predicate, CASE f.t WHEN 'ISIN' THEN 'isin:' ELSE 'debenture-trustee:' END || f.v AS object, f.chunk AS source_chunk
FROM f JOIN c i ON i.document = f.document AND i.t = 'Issuer' AND i.r = 1 LEFT JOIN c d ON d.document = f.document AND d.t = 'Debenture Trustee' AND d.r = 1
WHERE f.t = 'ISIN' OR (f.t = 'Debenture Trustee' AND f.v = d.v)
""")
def relations(spark, sf):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "Issuer").when(F.col("o_orderpriority") == "2-HIGH", "Debenture Trustee").otherwise("ISIN")
    value = F.concat(F.lit("v"), (F.col("o_orderkey") % 5).cast("string"))
    found = Tables(spark, sf).orders.select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("chunk_id"), F.lit(0).alias("seq"), kind.alias("entity_type"), value.alias("value"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"))
    by = ("document",)
    return entities.relations(found, entities.grouped(found, by=by), by=by).drop("start_page", "end_page")


@query("SELECT event_type AS entity_type, 'u' || user_id AS k FROM (SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2) ORDER BY n DESC, length('u' || user_id), 'u' || user_id LIMIT 1")
def canonical_pick(spark, sf):
    e = Tables(spark, sf).events
    kind = e.agg(F.min("event_type")).first()[0]
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    found = e.groupBy(F.col("event_type").alias("entity_type"), name.alias("key")).agg(F.collect_list("event_id").alias("mentions")).withColumn("value", F.col("key"))
    return entities.canonical(found, kind).select("entity_type", F.col("key").alias("k"))


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, 0 AS subject, user_id AS object FROM events WHERE user_id <> 0")
def cooccurrence_edges(spark, sf):
    e = Tables(spark, sf).events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return entities.pairs(e, ["day"], "user_id", F.lit(0))


@query("SELECT n_nationkey, coalesce('Region of ' || r_name, n_name) AS value FROM nation LEFT JOIN region ON lower(r_name) = lower(CASE WHEN n_nationkey % 2 = 0 THEN (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) ELSE n_name END)")
def alias_lookup(spark, sf):
    t = Tables(spark, sf)
    known = t.region.select(text.entity_key(F.col("r_name")).alias("key"), F.concat(F.lit("Region of "), "r_name").alias("name"))
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("value"))
    return entities.renamed(rows, known).select("n_nationkey", "value")


@query("SELECT source_id, score FROM (SELECT source_id, score, row_number() OVER (PARTITION BY source_id ORDER BY k, score DESC) AS r FROM (SELECT 'v' || (vec_id % 100) AS source_id, 0 AS k, vec_id::DOUBLE AS score FROM embeddings WHERE label = 1 UNION ALL SELECT 'v' || vec_id, 1, 0.5 FROM embeddings)) WHERE r = 1 AND source_id <> 'v7'")
def hybrid_candidates(spark, sf):
    e = Tables(spark, sf).embeddings
    first = e.filter("label = 1").selectExpr("concat('v', vec_id % 100) AS source_id", "'t' AS text", "'l' AS label", "double(vec_id) AS score")
    second = e.selectExpr("concat('v', vec_id) AS source_id", "'t' AS text", "'l' AS label", "0.5D AS score")
    seen = spark.createDataFrame([("v7",)], "source_id string")
    return retrieval.unseen(retrieval.candidates([first, second]), seen).select("source_id", "score")


@query("SELECT s_suppkey, form FROM (SELECT s_suppkey, unnest([s_name || ' Services Limited', s_name, CASE WHEN length(s_name) > 3 THEN split_part(s_name, ' ', 1) END]) AS form FROM supplier) WHERE form IS NOT NULL GROUP BY 1, 2")
def vocabulary_forms(spark, sf):
    s = Tables(spark, sf).supplier.select("s_suppkey", F.concat("s_name", F.lit(" Services Limited")).alias("name"))
    return s.select("s_suppkey", F.explode(text.match_forms(F.col("name"))).alias("form"))


@query("SELECT o_orderkey AS question_id, 'Issuer' AS kind, n_name AS name FROM orders JOIN nation ON n_nationkey = o_orderkey % 25")
def mention_match(spark, sf):
    t = Tables(spark, sf)
    known = t.nation.select(F.lit("Issuer").alias("kind"), F.col("n_name").alias("name"))
    asked = t.orders.join(search.small(t.nation), F.col("n_nationkey") == F.col("o_orderkey") % 25).select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("What does "), F.lower("n_name"), F.lit(" pay?")).alias("question"))
    return retrieval.mentioned(asked, retrieval.forms(known))


@query()
def stream_windows(spark, sf):
    """Events by type and day, as a stream that is read to its end."""
    import tempfile

    from ledgerlark.streaming import inbox

    events = spark.readStream.schema(Tables(spark, sf).events.schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out, at = tempfile.mkdtemp(), tempfile.mkdtemp()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:  # on a cluster only the shared folder will do
        import uuid

        out, at = (f"{base}/{uuid.uuid4().hex}" for _ in range(2))
    inbox.windowed_events(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long").parquet(out)
