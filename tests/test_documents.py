"""From cells and JSON to tables, graph and answers."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark import schema
from ledgerlark.functions import text
from ledgerlark.operators import assembly, canonical, entities, load, retrieval, search, staging, tables, vector
from ledgerlark.plans import catalogue, tools
from ledgerlark.plans import documents as documents_plan
from ledgerlark.sources import files
from ledgerlark.streaming import inbox


def fact(value, page=1, unit=None):
    return {"value": value, "unit": unit, "raw_value": value, "provenance": [{"document_id": "d", "page": page}]}


DOC = {
    "document": {"document_id": "pfc", "document_name": "PFC", "document_type": "NCD", "page_count": 9},
    "issuer": {"issuer_id": "i", "name": "Power Finance Corporation Limited", "issues": [{
        "issue_id": "pfc_1", "issue_name": "Tranche I Issue", "debenture_trustee": "Beacon Trusteeship Limited", "lead_managers": ["Nuvama", "Trust"],
        "terms": {"base_issue_size": fact("₹ 500 crore"), "additional_terms": {"put_call_option": fact("None")}},
        "ratings": [{"agency": "CRISIL", "rating": "AAA", "outlook": "Stable"}, {"agency": "CRISIL", "rating": "AA", "outlook": "Negative"}],
        "series": [{"series_id": "II", "series_name": "Series II", "terms": {"tenor": fact("10 years", 3), "face_value": fact("1000", 3, "INR")}, "provenance": [{"page": 3}], "categories": [{"category_id": "I_II", "category_name": None, "terms": {"coupon": fact("7.10005")}}]}],
    }]},
}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    (path / "a.json").write_text(json.dumps(DOC))
    return files.canonical(spark, str(path))


def test_relational_rows(docs):
    rows = canonical.relational(docs)
    terms = rows["series_category_terms"].orderBy("category_code").collect()
    assert [(r.category_code, str(r.coupon_percent)) for r in terms] == [("I", "7.1001"), ("II", "7.1001")]
    assert rows["ratings"].count() == 2 and rows["series"].first().tenor == "10 years"
    assert {(r.page_number, r.source_field) for r in rows["series_provenance"].collect()} == {(3, "series"), (3, "tenor"), (3, "face_value")}


def test_graph_keeps_last_rating(docs):
    _, edges = canonical.property_graph(docs)
    assert [r.outlook for r in edges.filter("type = 'RATED_BY'").collect()] == ["Negative"]
    assert edges.filter("type = 'HAS_LEAD_MANAGER'").count() == 2


def test_fact_chunks(docs):
    by = {r.chunk_id: r.text for r in canonical.fact_chunks(docs).collect()}
    assert "Base Issue Size: ₹ 500 crore" in by["pfc_1_overview"] and "Put Call Option: None" in by["pfc_1_overview"]
    assert "Face Value: 1000 INR" in by["pfc_1_series_II_cat_I_II"] and "Category I and Category II" in by["pfc_1_series_II_cat_I_II"]
    assert "Outlook: Stable" in by["pfc_1_rating_1"]


def test_missing_issuer_fails(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"document": {"document_id": "x"}}))
    with pytest.raises(Exception, match="needs document and issuer"):
        files.canonical(spark, str(tmp_path)).collect()


def test_loading_twice_changes_nothing(spark, docs, tmp_path):
    root = str(tmp_path)
    sizes = []
    for _ in range(2):
        inbox.loaded(docs, root)
        sizes.append({t: sorted(map(str, spark.read.parquet(f"{root}/{t}").collect())) for t in inbox.KEYS})
    assert sizes[0] == sizes[1]


def test_stream_loads_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(DOC))
    inbox.watched(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "series")).count() == 1


def cell(row, col, body, x0, x1, top=None, bottom=None):
    return ("d", 1, 0, row, col, body, float(x0), float(top if top is not None else row * 10), float(x1), float(bottom if bottom is not None else row * 10 + 10))


def test_series_terms_by_geometry(spark):
    rows = [
        cell(0, 0, "Series", 0, 50), cell(0, 1, "I", 50, 80), cell(0, 2, "II*", 80, 110),
        cell(1, 0, "Tenor", 0, 50), cell(1, 1, "24 months", 50, 80), cell(1, 2, "60 months", 80, 110),
        cell(2, 0, "Coupon (%) for NCD Holders in Category I & II", 0, 50), cell(2, 1, "8.5 %", 50, 110),
        cell(3, 0, "Face Value", 0, 50), cell(3, 1, "₹ 1,000", 50, 80), cell(3, 2, "Please see page 4", 80, 110),
    ]
    got = {(r.series_id, r.field, r.category): r.value_text or r.value_num for r in tables.series_terms(spark.createDataFrame(rows, schema.CELLS)).collect()}
    assert got == {("I", "tenor", None): "24 months", ("II", "tenor", None): "60 months", ("I", "coupon", "I_II"): 8.5, ("II", "coupon", "I_II"): 8.5, ("I", "face_value_inr", None): 1000.0}
    assert tables.table_scores(spark.createDataFrame(rows, schema.CELLS)).first().score == 7


def test_entities_and_relations(spark):
    chunks = spark.createDataFrame([
        (1, "Power Finance Corporation Limited (\"Issuer\") with Base Issue Size of nothing. ISIN INE134E08LX3", 1, 2),
        (2, "Power Finance Corporation Limited \"Issuer\" ... the Debenture Trustee Beacon Trusteeship Limited", 3, 3),
    ], "chunk_id int, text string, start_page int, end_page int")
    found = entities.mentions(chunks)
    grouped = entities.grouped(found)
    assert {"Issuer", "ISIN", "Debenture Trustee"} <= {r.entity_type for r in grouped.collect()}
    got = {(r.predicate, r.object, r.source_chunk) for r in entities.relations(found, grouped).collect()}
    assert ("HAS_ISIN", "isin:ine134e08lx3", 1) in got and ("HAS_DEBENTURE_TRUSTEE", "debenture-trustee:beacon-trusteeship-limited", 2) in got


def test_entities_are_each_documents_own(spark):
    chunks = spark.createDataFrame([
        ("a", 1, 'Power Finance Corporation Limited ("Issuer"). ISIN INE134E08LX3', 1, 1),
        ("b", 1, 'Capri Global Capital Limited ("Issuer"). ISIN INE180C07155', 4, 4),
        ("c", 1, "ISIN INE180C07163", 1, 1),
    ], "document string, chunk_id int, text string, start_page int, end_page int")
    found, related = entities.knowledge(chunks, ("document",))
    assert [(r.document, r.subject, r.object) for r in related.filter("predicate = 'HAS_ISIN'").collect()] == [
        ("a", "issuer:power-finance-corporation-limited", "isin:ine134e08lx3"), ("b", "issuer:capri-global-capital-limited", "isin:ine180c07155"),
    ]
    rows = [(r.document, r.entity_type, r.value) for r in found.collect()]
    assert rows == sorted(rows) and {d for d, *_ in rows} == {"a", "b", "c"}


def test_upserted_rows_are_taken_whole(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, None, 5), (3, "x", 1), (3, "y", 2), (None, "m", 1)], "k int, v string, seq int")
    assert {(r.k, r.v) for r in load.upserted(old, new, ["k"], ["v"], seq="seq").collect()} == {(1, None), (2, "b"), (3, "y"), (None, "m")}
    assert load.upserted(old, new.limit(0).drop("seq"), ["k"], ["v"]).count() == 3


def test_a_swap_that_broke_off_is_mended(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda v: spark.createDataFrame([(1, v)], "k int, v string")
    load.merge_into(spark, path, rows("a"), ["k"], True)
    (tmp_path / "t").rename(tmp_path / "t.old-1")
    load.merge_into(spark, path, rows(None), ["k"], True)
    load.merge_into(spark, path, spark.createDataFrame([(2, "b")], "k int, v string"), ["k"], True)
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, None), (2, "b")}


def test_from_cells_and_pages_to_documents_and_rows(spark):
    row = lambda d, page, series, field, category, t=None, n=None: (d, series, field, category, t, n, [page])
    terms = []
    for series, tenor, rate in (("I", "24 months", 8.5), ("II", "60 months", 9.0)):
        terms += [row("pfc", 7, series, "tenor", None, tenor), row("pfc", 7, series, "face_value_inr", None, n=1000.0), row("pfc", 8, series, "frequency", None, "Annual" if series == "I" else "Cumulative")]
        terms += [row("pfc", 7, series, "coupon", "III", n=rate + 0.1), row("pfc", 7, series, "coupon", "I_II", n=rate), row("pfc", 9, series, "put_call_option", None, "None"), row("pfc", 9, series, "nature_of_indebtedness", None, "Secured")]
    terms += [row("x", 1, "I", "tenor", None, "1 year"), row("x", 1, "I", "put_call_option", None, "No"), row("x", 1, "II", "tenor", None, "2 years")]
    terms = spark.createDataFrame(terms, "document_id string, series_id string, field string, category string, value_text string, value_num double, pages array<int>")
    pages = spark.createDataFrame([
        ("pfc", 1, 'Power Finance Corporation Limited ("Issuer"). This Tranche I Prospectus dated June 3, 2024. Base Issue Size: ₹ 500 crore. Shelf Limit of ₹ 10,000 crore'),
        ("pfc", 2, 'the Debenture Trustee Beacon Trusteeship Limited. Issue Opens on June 10, 2024'),
        ("pfc", 3, 'rated "ICRA AA (Stable)" for an amount of ₹ 500 crore by ICRA Limited vide its rating letter dated May 1, 2024'),
        ("x", 1, "nothing here"), ("y", 1, "no table"),
    ], "document_id string, page int, text string")
    out = assembly.documents(terms, pages)
    assert out.dtypes == spark.createDataFrame([], schema.DOCUMENT).dtypes
    by = {r.document.document_id: r for r in out.collect()}
    assert set(by) == {"pfc", "x"} and [r.document_id for r in assembly.without_series(terms, pages).collect()] == ["y"]
    pfc, (issue,) = by["pfc"], by["pfc"].issuer.issues
    assert pfc.issuer.name == "Power Finance Corporation Limited" and by["x"].issuer.name == "UNKNOWN" and pfc.document.page_count == 3
    assert issue.terms.base_issue_size.value == "₹ 500 crore" and issue.terms.shelf_limit.provenance[0].page == 1 and issue.debenture_trustee == "Beacon Trusteeship Limited"
    assert issue.terms.issue_open_date.value == "June 10, 2024" and [(r.agency, r.outlook, r.provenance[0].page) for r in issue.ratings] == [("ICRA Limited", "Stable", 3)]
    assert [s.series_id for s in issue.series] == ["I", "II"] and [c.category_id for c in issue.series[0].categories] == ["III", "I_II"]
    one = issue.series[1]
    assert one.terms.tenor.value == "60 months" and one.terms.coupon_type.value == "Cumulative" and one.terms.face_value.unit == "INR" and one.terms.face_value.provenance[0].page == 7
    assert issue.terms.security_type.value == "Secured" and issue.terms.additional_terms["put_call_option"].value == "None" and one.terms.put_call_option is None
    assert by["x"].issuer.issues[0].series[0].terms.put_call_option.value == "No"  # only one series states it
    assert [c.chunk_id for c in pfc.chunks][:2] == ["pfc_issue_1_overview", "pfc_issue_1_rating_1"] and len(pfc.chunks) == 6
    rows = canonical.relational(out)
    assert {(r.series_code, r.category_code, str(r.coupon_percent)) for r in rows["series_category_terms"].collect()} >= {("I", "I", "8.5000"), ("II", "III", "9.1000")}
    vertices, edges = canonical.property_graph(out)
    assert edges.filter("type = 'HAS_SERIES'").count() == 4


def test_structure_takes_the_best_evidence(spark):
    """a: an outline that headings confirm; b: an outline that nothing confirms, so the visible contents; c: headings alone."""
    from ledgerlark.operators import structure

    titles = ["Risk Factors", "Terms of the Issue", "Issue Structure"]
    heads = [(d, 10 * k + 10, 1, t.upper(), 18.0 - k, True) for d in "abc" for k, t in enumerate(titles)] + [("a", 12, 3, "Internal Risks", 12.0, False)]
    found = spark.createDataFrame(heads, "document string, page_number int, line_no int, text string, size double, bold boolean")
    toc = [("b", 2, k, f"{t} ........ {10 * k + 8}", [50.0, 0.0, 0.0, 0.0]) for k, t in enumerate(titles)] + [(d, 2, 9, "plain", [50.0, 0.0, 0.0, 0.0]) for d in "ac"]
    lines = spark.createDataFrame(toc, "document string, page_number int, line_no int, text string, bbox array<double>")
    outline = [("a", 1, 1, "Risk factors", 10), ("a", 2, 2, "Internal risks", 12), ("a", 3, 1, "Terms of the issue", 20), ("a", 4, 1, "No such heading", 25)] + [("b", k, 1, f"bookmark {k}", k) for k in range(1, 5)]
    outline = spark.createDataFrame(outline, "document string, section_no int, level int, title string, page int")
    totals = spark.createDataFrame([(d, 40) for d in "abc"], "document string, total_pages int")
    rows = structure.detected(outline, lines, found, totals).orderBy("document", "section_no").collect()
    assert {r.document: r.strategy for r in rows} == {"a": "outline", "b": "contents", "c": "layout"}
    assert [(r.title, r.start_page, r.end_page, r.confidence) for r in rows if r.document == "a"] == [("Risk factors", 10, 19, "medium"), ("Internal risks", 12, 19, "medium"), ("Terms of the issue", 20, 24, "medium"), ("No such heading", 25, 40, "low")]
    assert [(r.title, r.start_page, r.end_page) for r in rows if r.document == "b"] == [("Risk Factors", 10, 19), ("Terms of the Issue", 20, 29), ("Issue Structure", 30, 40)]
    assert [(r.title, r.end_page, r.confidence) for r in rows if r.document == "c"] == [("RISK FACTORS", 19, "low"), ("TERMS OF THE ISSUE", 29, "low"), ("ISSUE STRUCTURE", 40, "low")]


def test_sql_guard(spark):
    assert tools.sql_query(spark, "SELECT ' update ' AS a").data == [{"a": " update "}]
    for bad in ("DROP TABLE x", "SELECT 1; DROP TABLE x", "INSERT INTO x VALUES (1)", "SET a=b", "nonsense", "CREATE TABLE y AS SELECT 1"):
        assert tools.sql_query(spark, bad).error == "rejected", bad
    cut = tools.sql_query(spark, "SELECT id FROM range(300)")
    assert cut.truncated and cut.row_count == 200


def test_routing_and_loop(spark):
    known = spark.createDataFrame([("Issuer", "Power Finance Corporation Limited"), ("Agency", "CRISIL Ratings Limited")], "kind string, name string")
    asked = spark.createDataFrame([(1, "What did crisil say of Power Finance Corporation series iv, category II?")], "question_id int, question string")
    got = {r.kind: r.name for r in retrieval.mentioned(asked, retrieval.forms(known)).collect()}
    assert got == {"Issuer": "Power Finance Corporation Limited", "Agency": "CRISIL Ratings Limited"}
    route = asked.select(retrieval.routes(F.col("question")).alias("r")).first().r
    assert (route.series, route.category, route.overview) == ("IV", "II", False)

    class Scripted:
        def propose(self, question, known):
            return ["a"] if len(known) < 2 else []

        def select(self, question, subs, found):
            return 0

        def answer(self, question, known):
            return ",".join(c["source_id"] for c in known)

    trace = retrieval.answered("q", Scripted(), lambda q: [{"source_id": "x"}, {"source_id": "y"}])
    assert trace.answer == "x,y" and len(trace.rounds) == 2


def test_candidates_first_source_wins(spark):
    part = lambda rows: spark.createDataFrame(rows, "source_id string, text string, label string, score double")
    got = retrieval.candidates([part([("a", "t1", "l", 0.5)]), part([("a", "t2", "l", 1.0), ("b", "t", "l", 0.1)])])
    assert {r.source_id: r.text for r in got.collect()} == {"a": "t1", "b": "t"}


def test_many_queries_in_blocks(spark, monkeypatch):
    import numpy as np

    from ledgerlark.operators import vector

    monkeypatch.setattr(vector, "QUERIES", 4)
    monkeypatch.setattr(vector, "ROWS", 16)
    x = np.random.default_rng(1).standard_normal((90, 8))
    x[50:60] = x[3]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector.top_k_of_each(rows.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), rows, 6).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    want = {(q, r + 1): int(i) for q in range(0, 90, 5) for r, i in enumerate(np.lexsort((np.arange(90), -scores[q]))[:6])}
    assert {(r.query_id, r.rank): round(float(scores[r.query_id, r.key]), 9) for r in got} == {at: round(float(scores[at[0], i]), 9) for at, i in want.items()}


@pytest.fixture(scope="module")
def stored_tables(docs):
    return canonical.relational(docs)


def test_bond_terms_tool(stored_tables):
    got = tools.search_bond_terms(stored_tables, series_code="II", tenor="10", issuer=None)
    assert got.ok and got.row_count == 2 and not got.truncated and list(got.data[0]) == search.TERM_COLUMNS
    assert [r["category_code"] for r in got.data] == ["I", "II"] and got.data[0]["frequency"] is None
    assert got.citations[0] == {"source_type": "sql", "source_id": "series:pfc_1:II", "document_name": "PFC", "page_number": 3, "section": "Series II / Category I"}
    cut = tools.search_bond_terms(stored_tables, cap=1)
    assert cut.row_count == 1 and cut.truncated
    assert tools.search_bond_terms(stored_tables, issuer="Nobody").data == []


def test_issue_overview_tool(stored_tables):
    got = tools.get_issue_overview(stored_tables, document_name="PFC")
    assert list(got.data[0]) == [*search.ISSUE_COLUMNS, "ratings", "lead_managers"]
    row = got.data[0]
    assert row["issue_size"] == "₹ 500 crore" and row["lead_managers"] == ["Nuvama", "Trust"] and [r["rating"] for r in row["ratings"]] == ["AA", "AAA"]
    assert got.citations == [{"source_type": "sql", "source_id": "issue:pfc_1", "document_name": "PFC", "section": "Tranche I Issue"}]
    without = {**stored_tables, "ratings": stored_tables["ratings"].limit(0), "lead_managers": stored_tables["lead_managers"].limit(0)}
    assert tools.get_issue_overview(without).data[0]["ratings"] == []


def test_structured_candidates(spark, stored_tables):
    asked = spark.createDataFrame([
        (1, "What is the coupon of Series ii for Category I of Power Finance Corporation?"), (2, "Who is the trustee of power finance corporation limited?"), (3, "What did NUVAMA do?"), (4, "What is a bond?"), (5, "Who is the trustee?"), (6, "Terms of Series IX?"),
        (7, None),
    ], "question_id long, question string")
    got = {}
    for r in retrieval.structured_candidates(asked, stored_tables).collect():
        got.setdefault(r.question_id, []).append(r)
    assert sorted(got) == [1, 2, 3]
    assert [r.source_id for r in got[1]] == ["sql:series:pfc_1:II"] and got[1][0].label == "[SQL] PFC — Series II / Category I"
    assert got[1][0].text == "Power Finance Corporation Limited Series II Category I: tenor 10 years, face value INR 1000.00, coupon 7.1001%."
    assert got[2][0].text == "Power Finance Corporation Limited (Tranche I Issue): issue size ₹ 500 crore, debenture trustee Beacon Trusteeship Limited, ratings - CRISIL: AA; CRISIL: AAA, lead managers - Nuvama, Trust."
    assert [(r.source_id, r.text) for r in got[3]] == [("graph:pfc_1:LeadManager:Nuvama", "Power Finance Corporation Limited (Tranche I Issue, PFC): Nuvama served as LeadManager.")]


def test_a_file_name_is_an_alias(spark):
    rows = spark.createDataFrame([("a/pfc_ncd_2026.pdf",), ("ab_x.pdf",), (None,)], "p string").select(text.file_alias(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["pfc", None, None]


def test_vector_store_replaces_documents(spark, tmp_path):
    columns = "chunk_id string, text string, document_name string, start_page int, section_path string, section string, subsection string, chunk_type string, issuer string, document_type string, series_id string, category_id string, end_page int"
    row = lambda i, t, d: (i, t, d, 2, "", "", "", "prose", "I", "NCD", "II", None, 2)
    embed, path = vector.hashing_embedder(), str(tmp_path / "store")
    vector.stored(spark.createDataFrame([row("a1", "coupon rate", "a"), row("a2", "old", "a"), row("b1", "trustee name", "b"), row("c1", "gone", "c")], columns), embed, path)
    vector.stored(spark.createDataFrame([row("a1", "coupon of the bond", "a"), row("a3", " ", "a"), row("c1", "  ", "c")], columns), embed, path)
    held = vector.held(spark, path)
    assert sorted((r.chunk_id, r.text) for r in held.collect()) == [("a1", "coupon of the bond"), ("b1", "trustee name")]
    got = tools.vector_search(held, "trustee name", embed, top_k=1, issuer="I", chunk_type=None)
    assert list(got.data[0]) == tools.HIT and got.data[0]["chunk_id"] == "b1" and got.citations[0]["confidence"] == pytest.approx(1.0)
    asked = spark.createDataFrame([(7, "coupon of the bond")], "question_id long, question string")
    best = retrieval.vector_candidates(asked, held, embed, 1).collect()
    assert [(r.question_id, r.source_id, r.label) for r in best] == [(7, "a1", "a — p.2 — II")] and best[0].atom == "coupon of the bond [a — p.2 — II]: coupon of the bond"


def test_texts_are_embedded_a_few_megabytes_at_a_time(spark, monkeypatch):
    def sized(c, embed):
        return F.pandas_udf(lambda s: pd.Series([[float(len(s))]] * len(s)), "array<float>")(c)

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    catalogue.QUERIES["vector_candidates"](spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(vector, "embedding_of", sized)
    texts = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('some words ', 400) text")
    got = [r.embedding[0] for r in vector.embedded(texts, vector.hashing_embedder()).collect()]
    assert len(got) == 3000 and max(got) < 1300  # 4,400 bytes each: under 5.8 MB


def test_tables_are_made_once_and_graph_merges(spark, docs, tmp_path):
    root = str(tmp_path / "tables")
    inbox.seeded(spark, root)
    assert spark.read.parquet(f"{root}/series").count() == 0
    inbox.loaded(docs, root)
    inbox.seeded(spark, root)
    assert sorted(r.category_name for r in spark.read.parquet(f"{root}/investor_categories").collect()) == [f"Category {c}" for c in ("I", "II", "III", "IV")]
    assert spark.read.parquet(f"{root}/series").count() == 1
    for _ in range(2):
        inbox.linked(docs, root)
    vertices, edges = canonical.property_graph(docs)
    assert spark.read.parquet(f"{root}/vertices").count() == vertices.count() and spark.read.parquet(f"{root}/edges").count() == edges.count()


@pytest.mark.parametrize(("reply", "value"), [('{"a": 1}', {"a": 1}), ('so:\n```json\n["x"]\n```\nend', ["x"]), ("none", None), ("```\n{\n```", None)])
def test_reply_value(reply, value):
    assert retrieval.reply_value(reply) == value


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["series_terms", "document_series", "shared_terms", "table_scores"])
def test_tables_meet_in_one_shuffle_and_are_never_broadcast(spark, query):
    plan = _planned(catalogue.QUERIES[query](spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in plan and "Join" not in plan and plan.count("Exchange ") == 1


@pytest.mark.parametrize("query", ["series_terms", "table_scores", "document_series"])
def test_tables_are_grouped_as_they_come(spark, query):
    """Rows lie in the groups' order: no partial groups are made and put together again."""
    plan = _planned(catalogue.QUERIES[query](spark, "/root/testdata/sf0.001"))
    assert "SortAggregate" in plan and "HashAggregate" not in plan and "partial_" not in plan


def test_terms_of_several_tables_and_rows(spark):
    """The first table gives a field, the last a category; in one table the later row wins; a value that cannot be read gives nothing; a category may be named twice."""
    head = [cell(0, 0, "Series", 0, 50), cell(0, 1, "I", 50, 80), cell(0, 2, "II", 80, 110)]
    one = [*head, cell(1, 0, "Tenor", 0, 50), cell(1, 1, "1 year", 50, 80), cell(2, 0, "Tenor again", 0, 50), cell(2, 1, "2 years", 50, 80), cell(2, 2, None, 80, 110), cell(3, 0, "Coupon (%) Category II, I & II", 0, 50), cell(3, 1, "8 %", 50, 110)]
    two = [*head, cell(1, 0, "tenor", 0, 50), cell(1, 1, "3 years", 50, 110), cell(2, 0, "coupon category i and ii", 0, 50), cell(2, 1, "9%", 50, 80), cell(2, 2, "n.a.", 80, 110)]
    rows = one + [(d, 2, *rest) for d, _, *rest in two] + [("d", None, *rest) for _, _, *rest in two]
    got = {(r.series_id, r.field, r.category): (r.value_text or r.value_num, r.pages) for r in tables.series_terms(spark.createDataFrame(rows, schema.CELLS)).collect()}
    assert got == {("I", "tenor", None): ("2 years", [1, 2]), ("II", "tenor", None): ("3 years", [2]), ("I", "coupon", "I_II"): (9.0, [1, 2]), ("II", "coupon", "I_II"): (8.0, [1])}


def test_terms_may_go_over_cells_and_need_a_row_and_a_place(spark):
    rows = [cell(0, 0, "Series", 0, 50), cell(0, 1, "I", 50, 80), cell(0, 2, "II", 80, 110), cell(1, 0, "Face", 0, 20), cell(1, 1, "value", 20, 50), cell(1, 2, "₹ 10", 50, 110)]
    assert tables.table_scores(spark.createDataFrame(rows, schema.CELLS)).first().score == 5
    header = [cell(0, 0, "Series", 0, 50), cell(0, 1, "I", 50, 80), cell(0, 2, "II", 50, 80)]
    assert tables.table_scores(spark.createDataFrame(header + rows[3:], schema.CELLS)).count() == 0


def test_assembly_never_broadcasts_what_grows_with_documents(spark):
    t = catalogue.Tables(spark, "/root/testdata/sf0.001")
    rows = catalogue.QUERIES["assembled_chunks"](spark, t.folder)
    assert "Broadcast" not in _planned(rows)
    terms = tables.series_terms(documents_plan._cells(t))
    assert "Join" not in _planned(assembly.shared(assembly.series(terms)))


PAGES = [
    ("a", 1, 'Power Finance Corporation Limited ("Issuer"). Lead Manager Trust Investment Advisors Private Limited'), ("a", 2, 'Power Finance Corporation Limited ("Issuer"). Debenture Trustee Beacon Trusteeship Limited'),
    ("b", 1, "credit rating letter dated March 3, 2025 by CRISIL Ratings Limited assigning a rating of “AA Stable”"), ("c", 1, None),
]


def test_a_documents_entities_are_grouped_once(spark):
    said = assembly.domain(spark.createDataFrame(PAGES, "document_id string, page int, text string"))
    assert _planned(said).count("SortMergeJoin") <= 6
    got = {r.document_id: r for r in said.collect()}
    assert (got["a"].issuer, got["a"].issuer_page, got["a"].trustee_page) == ("Power Finance Corporation Limited", 1, 1)
    assert got["a"].lead_managers == ["Power Finance Corporation Limited", "Trust Investment Advisors Private Limited"] and got["b"].lead_managers is None
    assert got["b"].issuer is None and [r.rating for r in got["b"].ratings] == ["AA Stable"] and got["c"].page_count == 1


def test_python_reads_only_texts_that_may_hold_what_it_seeks(spark):
    pages = spark.createDataFrame(PAGES, "document_id string, page int, text string").withColumn("chunk_id", F.lit(1))
    assert "letter dated" in _planned(assembly.domain(pages.drop("chunk_id")))
    aliases = entities.alias_map(pages, "chunk_id", by=("document_id",))
    assert "RLIKE" in _planned(aliases) and aliases.count() == 0
    quoted = spark.createDataFrame([("a", 1, '"PFC" Power Finance Corporation Limited')], "document_id string, chunk_id int, text string")
    assert [(r.key, r.name) for r in entities.alias_map(quoted, "chunk_id", by=("document_id",)).collect()] == [("pfc", "Power Finance Corporation Limited")]


def test_shared_terms_are_not_copied_into_another_type(spark):
    terms = spark.createDataFrame([("d", s, None, "tenor", "1 year", None, [1]) for s in ("I", "II")], "document_id string, series_id string, category string, field string, value_text string, value_num double, pages array<int>")
    plan = assembly.shared(assembly.series(terms))._jdf.queryExecution().optimizedPlan().toString()
    assert "as array<struct<series_id" not in plan and "as struct<series_id" not in plan


def test_edges_come_from_one_pass(spark, docs):
    _, edges = canonical.property_graph(docs)
    plan = _planned(edges)
    assert plan.count("Exchange ") == 1 and "Union" not in plan
    rows = {(r.type, r.target): r.outlook for r in edges.collect()}
    assert rows["RATED_BY", "CRISIL"] == "Negative" and rows["HAS_LEAD_MANAGER", "Trust"] is None and len(rows) == edges.count() == 6


def test_leaves_end_their_sections_once(spark):
    assert "MapInArrow" not in _planned(catalogue.QUERIES["leaf_sections"](spark, "/root/testdata/sf0.001"))


def test_queries_over_documents_make_only_what_they_read(spark):
    plan = lambda name: catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    ratings = plan("rating_chunks")
    assert "Series " not in ratings and "crore" not in ratings
    assert "Agency " not in plan("structured_fact_chunks") and "lineitem" not in plan("overview_chunk") and "Join" not in plan("overview_chunk")


def test_participations_of_some_names(spark, stored_tables):
    whole = search.participations(stored_tables)
    names = spark.createDataFrame([("Nuvama",), ("CRISIL",)], "participant_name string")
    got = search.participations(stored_tables, names=names).collect()
    assert sorted(got) == sorted(r for r in whole.collect() if r.participant_name in ("Nuvama", "CRISIL")) and got
    assert "Join" not in search.participations(stored_tables | {"lead_managers": stored_tables["lead_managers"].limit(0), "ratings": stored_tables["ratings"].limit(0)}, search.known_issues(stored_tables).localCheckpoint())._jdf.queryExecution().optimizedPlan().toString()


def test_an_issue_in_two_rows_has_the_trustees_of_both(spark):
    issues = spark.createDataFrame([("D1", "i", "n", "T1"), ("D2", "i", "n", "T2"), ("D2", "j", "n", None)], "document_name string, issue_identifier string, issue_name string, debenture_trustee string")
    none = spark.createDataFrame([], "issue_id string, name string, agency string")
    documents = spark.createDataFrame([("I1", "D1"), ("I2", "D2")], "issuer_name string, document_name string")
    got = search.participations({"issues": issues, "documents": documents, "lead_managers": none, "ratings": none})
    assert sorted((r.document_name, r.participant_name) for r in got.collect()) == [("D1", "T1"), ("D1", "T2"), ("D2", "T1"), ("D2", "T2")]


def test_only_what_is_asked_is_looked_up(spark, stored_tables, monkeypatch):
    asked = spark.createDataFrame([(1, "What did NUVAMA do?"), (2, "And Nuvama?"), (3, None)], "question_id long, question string")
    monkeypatch.setattr(search, "bond_terms", None)  # no question asks for terms
    got = retrieval.structured_candidates(asked, stored_tables, cap=1).collect()
    assert sorted((r.question_id, r.source_id) for r in got) == [(1, "graph:pfc_1:LeadManager:Nuvama"), (2, "graph:pfc_1:LeadManager:Nuvama")]


def test_partitions_follow_the_rows(spark):
    rows = spark.range(10)
    assert staging.spread(rows, 10, "id").rdd.getNumPartitions() == 4 and staging.spread(rows, 9 * staging.ROWS + 1, "id").rdd.getNumPartitions() == 10


def test_two_scans_are_compared_in_one_join(spark):
    both = [("a", 1, 0, 0), ("a", 1, 0, 1), ("a", 1, 1, 0), ("b", 1, 0, 0), ("c", 1, 0, None)]
    cells = spark.createDataFrame([*both, ("a", 1, 1, 1), ("b", 1, 1, 0), ("a", 2, 0, 0), ("d", 1, None, 0), (None, 1, 0, 0)], "document_id string, page int, table_idx int, row int")
    grid = spark.createDataFrame([*both, ("e", 1, 0, 0), ("d", 1, None, 0), (None, 1, 0, 0)], cells.schema)
    kept = tables.consistent(grid, cells)
    # b has a table more in one scan, table 1 of a a row more, page 2 of a is in one scan alone
    assert sorted(map(tuple, kept.collect()), key=str) == [("a", 1, 0, 0), ("a", 1, 0, 1), ("c", 1, 0, None)]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
