"""The SQL guard, the graph tools and the routing rule."""

import pytest

from ledgerlark.operators import graph, search, tables
from ledgerlark.plans import tools


@pytest.fixture(scope="module")
def some(spark):
    spark.range(5).selectExpr("id", "id % 2 AS half").createOrReplaceTempView("some_rows")


@pytest.mark.parametrize("statement", [
    "SELECT * FROM some_rows", "WITH a AS (SELECT id FROM some_rows), b AS (SELECT * FROM a) SELECT count(*) FROM b WHERE id IN (SELECT half FROM some_rows)",
    "SELECT half, sum(id) OVER (PARTITION BY half ORDER BY id) FROM some_rows", "SELECT explode(sequence(1, 3)) AS x", "SELECT * FROM range(3)", "SELECT transform(array(1, 2), x -> x + 1), coalesce(null, 1)",
    "SELECT half, count(*) FROM some_rows GROUP BY CUBE (half) HAVING count(*) > 1 ORDER BY 1 LIMIT 2", "SELECT * FROM some_rows LATERAL VIEW explode(array(1, 2)) t AS y", "SELECT id FROM some_rows INTERSECT SELECT 1 UNION SELECT max(id) FROM some_rows",
    "SELECT * FROM (VALUES (1, 'a')) AS t(a, b)", "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r",
])
def test_queries_pass(spark, some, statement):
    answer = tools.sql_query(spark, statement)
    assert answer.ok and answer.row_count, answer


@pytest.mark.parametrize("statement", [
    "SELECT reflect('java.lang.Integer', 'parseInt', '41')", "SELECT java_method('java.lang.System', 'exit', '1')", "SELECT try_reflect('java.lang.Integer', 'parseInt', 'x')", "SELECT 1 WHERE EXISTS (SELECT reflect('java.lang.Integer', 'parseInt', '41'))",
    "SELECT id FROM some_rows WHERE id = (SELECT max(reflect('java.lang.Integer', 'parseInt', '4')) FROM some_rows)", "WITH a AS (SELECT reflect('java.lang.Integer', 'parseInt', '41') AS x) SELECT * FROM a",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT * FROM some_rows JOIN text.`/etc/passwd` ON true", "SELECT (SELECT count(*) FROM csv.`/etc/passwd`)", "SELECT * FROM nowhere", "SELECT input_file_name() FROM some_rows",
    "DROP TABLE some_rows", "INSERT INTO some_rows VALUES (1, 2)", "CREATE TABLE t AS SELECT 1", "SET a = b", "SELECT 1; SELECT 2", "EXPLAIN SELECT 1", "WITH a AS (SELECT 1) INSERT INTO some_rows SELECT 1, 2", "SELECT TRANSFORM (id) USING 'cat' FROM some_rows", "SHOW TABLES",
])
def test_others_are_refused(spark, some, statement):
    assert tools.sql_query(spark, statement).error == "rejected", statement


EDGES = [("X", "ISSUED", "i1", None), ("X", "ISSUED", "i2", None), ("Y", "ISSUED", "i3", None), ("i1", "HAS_SERIES", "II", None), ("i1", "HAS_SERIES", "I", None), ("i1", "RATED_BY", "CRISIL", "Stable"), ("i1", "HAS_DEBENTURE_TRUSTEE", "Beacon Ltd", None), ("i3", "HAS_DEBENTURE_TRUSTEE", "Beacon Ltd", None), ("i3", "HAS_LEAD_MANAGER", "A Capital", None)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "source string, type string, target string, outlook string")


def test_issuer_neighborhood(edges):
    answer = tools.issuer_neighborhood(edges, "X", depth=9)
    assert answer.row_count == 2 and not answer.truncated and answer.citations[0] == {"source_type": "graph", "source_id": "issue:i1"}
    assert answer.data[0] == {"issuer": "X", "issue_id": "i1", "series_numbers": ["I", "II"], "ratings": [{"agency": "CRISIL", "outlook": "Stable"}], "debenture_trustees": ["Beacon Ltd"], "lead_managers": []}
    assert answer.data[1] == {"issuer": "X", "issue_id": "i2", "series_numbers": [], "ratings": [], "debenture_trustees": [], "lead_managers": []}
    assert tools.issuer_neighborhood(edges, "nobody").row_count == 0


def test_participants(edges):
    found = lambda *a: [(r["issuer"], r["issue_id"], r["participant"], r["role"]) for r in tools.find_issues_by_participant(edges, *a).data]
    assert found("beacon") == found("BEACON", "trustee") == [("X", "i1", "Beacon Ltd", "DebentureTrustee"), ("Y", "i3", "Beacon Ltd", "DebentureTrustee")]
    assert found("beacon", "lead_manager") == [] and found("c", "rating_agency") == [("X", "i1", "CRISIL", "RatingAgency")]
    assert tools.find_issues_by_participant(edges, "", "any", 2).truncated


def test_depth(spark, edges):
    answer = tools.neighborhood_to_depth(edges, "X", 3)
    assert {r["node"]: r["depth"] for r in answer.data} == {"X": 0, "i1": 1, "i2": 1, "II": 2, "I": 2, "CRISIL": 2, "Beacon Ltd": 2, "i3": 3}
    ring = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)] + [(0, 1), (None, 2), (3, None), (2, 2)], "source int, target int")
    got = {(r.start, r.node): r.depth for r in graph.reached(spark.createDataFrame([(0,), (2,), (None,), (9,), (0,)], "node int"), ring, 50).collect()}
    assert got == {(0, i): i for i in range(5)} | {(2, (2 + i) % 5): i for i in range(5)} | {(9, 9): 0}


ROUTED = [
    ("Tenor", "3 years", "tenor"), ("Frequency of Interest Payment", "Annual", "frequency"), ("Frequency of payment", "Annual", "frequency"), ("Minimum Application", "10", "minimum_application"), ("Face Value", "1,000", "face_value_inr"), ("Issue Price", "1,000", "issue_price"),
    ("Coupon (%)", "8.5 %", "coupon"), ("Effective Yield", "8.6 %", "effective_yield"), ("Mode of Interest Payment", "Bank", "mode_of_interest_payment"), ("Amount on Maturity", "1,000", "maturity_amount"), ("Maturity / Redemption Date", "2030", "maturity_redemption"),
    ("Nature of Indebtedness", "Secured", "nature_of_indebtedness"), ("Put and Call Option", "None", "put_call_option"),
    ("Maturity date", "2030", None), ("Redemption", "2030", None), ("Frequency", "Annual", None), ("Yield", "8 %", None), ("Put option", "None", None), ("Application", "1", None), ("Face", "1", None), ("Price", "1", None), ("Interest", "x", None), ("Coupon", "none", None), ("Amount on maturity", "none", None), (None, "x", None),
]


def test_routing(spark):
    got = tables.routed(spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(ROUTED)], "i int, label string, value string"))
    assert {r.i: r.field for r in got.collect()} == {i: f for i, (_, _, f) in enumerate(ROUTED) if f}


def test_collation(spark):
    rows = spark.createDataFrame([(1, "Power Ltd"), (2, "POWER LTD"), (3, "Pöwer Ltd"), (4, None)], "i int, name string")
    ids = lambda *a: sorted(r.i for r in search.matching(rows, *a).collect())
    assert ids({"name": "power ltd"}) == [] and ids({"name": "power ltd"}, None, "UTF8_LCASE") == [1, 2] and ids({"name": "power ltd"}, None, "UNICODE_CI_AI") == [1, 2, 3]
    assert ids(None, {"name": "power"}) == [] and ids(None, {"name": "WER_l"}, "UTF8_LCASE") == [1, 2, 3] and ids({"i": 2}, {"name": "pow"}, "UTF8_LCASE") == [2]
