"""From files to tables, graph and vectors."""

import json

import pytest

from ledgerlark import schema
from ledgerlark.operators import chain, vector
from ledgerlark.operators.snapshots import Store
from ledgerlark.streaming import inbox


def line(text, y, bold=False):
    return {"text": text, "size": 10.04, "bold": bold, "fonts": ["Serif"], "bbox": [50.0, float(y), 300.0, y + 10.0]}


def layout(name, *pages):
    return {"document": name, "total_pages": len(pages), "outline": [], "pages": [{"page_number": n, "width": 600.0, "height": 800.0, "lines": p} for n, p in enumerate(pages, 1)]}


def cells(name, page):
    rows = [["Series", "I", "II"], ["Tenor", "24 months", "60 months"], ["Nature of Indebtedness", "Secured", "Secured"]]
    return [{"document_id": name, "page": page, "table_idx": 0, "row": r, "col": c, "text": t, "x0": 50.0 * c, "top": 10.0 * r, "x1": 50.0 * c + 50, "bottom": 10.0 * r + 10} for r, row in enumerate(rows) for c, t in enumerate(row)]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "layouts").mkdir()
    one = layout("one", [line("General", 100, True), line('about Power Finance Corporation Limited ("Issuer"). Base Issue Size: ₹ 500 crore', 120), line("  ", 130)], [line("Risk factors", 100, True), line("There are risks.", 120)], [line("Series I II", 100)])
    two = layout("two", [line("Nothing bold here", 100)], [line("Series I II", 100)])
    for doc in (one, two):
        (tmp_path / "layouts" / f"{doc['document']}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "cells.json").write_text("\n".join(json.dumps(c) for c in cells("one", 3) + cells("two", 2)))
    return tmp_path


def test_files_become_tables_graph_and_vectors(spark, folder):
    store = Store(spark, str(folder / "store"), buckets=2)
    assert chain.from_files(store, str(folder / "layouts"), str(folder / "cells.json"), str(folder / "vectors")) == 1
    kinds = {n: c.rows.schema for n, c in inbox.changes_of(spark.createDataFrame([], schema.DOCUMENT)).items()}
    read = lambda name, *columns: sorted(tuple(r) for r in store.table(name, kinds[name]).select(*columns).collect())
    assert read("issuers", "issuer_name") == [("Power Finance Corporation Limited",), ("UNKNOWN",)]
    assert read("series", "issue_id", "series_code", "tenor") == [(f"{d}_issue_1", s, t) for d in ("one", "two") for s, t in (("I", "24 months"), ("II", "60 months"))]
    edges = store.table("edges", spark.createDataFrame([], "source string, type string, target string, outlook string").schema)
    assert {(r.source, r.target) for r in edges.filter("type = 'ISSUED'").collect()} == {("Power Finance Corporation Limited", "one_issue_1"), ("UNKNOWN", "two_issue_1")}
    held = vector.held(spark, str(folder / "vectors"))
    prose = {(r.document_name, r.chunk_id, r.section, r.start_page, r.end_page) for r in held.filter("chunk_type = 'prose'").collect()}
    assert prose == {("one", "one_0001", "General", 1, 1), ("one", "one_0002", "Risk factors", 2, 2)}  # pages with tables give none, nor do documents without sections
    assert held.filter("chunk_type <> 'prose'").count() >= 2


def test_a_document_without_series_fails_the_call(spark, folder):
    (folder / "cells.json").write_text("\n".join(json.dumps(c) for c in cells("one", 3)))
    store = Store(spark, str(folder / "store"), buckets=2)
    with pytest.raises(RuntimeError, match="two"):
        chain.from_files(store, str(folder / "layouts"), str(folder / "cells.json"), str(folder / "vectors"))
    assert store.versions() == []
