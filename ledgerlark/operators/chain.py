"""From layout and cell files to nested documents, and from these to tables, graph and vectors, in one call each.

Every step is keyed by the document; documents never meet. What several later steps read is written once to the shared folder.
Documents without lines have no pages and so no facts of their own; null document ids are left out; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators import assembly, canonical, chunking, intervals, snapshots, structure, tables, vector
from ledgerlark.operators.staging import staged
from ledgerlark.sources import files
from ledgerlark.streaming import inbox


@dataclass
class Parts:
    """What was read out of the files: pages (document_id, page, text), terms of series, leaf sections with paths, prose chunks."""

    pages: DataFrame
    terms: DataFrame
    sections: DataFrame
    prose: DataFrame


def leaf_sections(layouts: DataFrame, lines: DataFrame) -> DataFrame:
    """document, section_no, start_page, end_page, path of the sections that hold no deeper one, by each document's best evidence."""
    body = intervals.most_common(lines.withColumn("seq", F.struct("page_number", "line_no")), ["document"], "size", "seq")
    found = staged(structure.headings(lines, body.select("document", F.col("size").alias("body_size"))).drop("body_size"), "chain-headings")
    outline = files.outline(layouts).select("document", (F.col("seq") + 1).alias("section_no"), "level", "title", "page")
    whole = structure.detected(outline, lines, found, layouts.select("document", "total_pages"))
    whole = staged(whole.select("document", "section_no", "level", "title", "start_page", "end_page"), "chain-sections")
    paths = intervals.section_paths(whole, "document", "section_no", "level", "title").select("document", "section_no", "path")
    return intervals.leaves(whole, "document", "section_no", "level").join(paths, ["document", "section_no"]).select("document", F.col("section_no").cast("int").alias("section_no"), "start_page", "end_page", "path")


def parts(layouts: DataFrame, cells: DataFrame, grid: DataFrame | None = None) -> Parts:
    """layouts: schema.LAYOUT; cells, and grid of a second scan that must agree with it: schema.CELLS.

    Pages with a table of series give no prose.
    """
    layouts = layouts.filter("document IS NOT NULL")
    lines = staged(files.lines(layouts), "chain-lines")
    cells = cells if grid is None else tables.consistent(grid, cells)
    text = chunking.page_texts(lines, ["document", "page_number"], "line_no", "text")
    pages = staged(text.select(F.col("document").alias("document_id"), F.col("page_number").alias("page"), "text"), "chain-pages")
    excluded = tables.header_rows(cells).select(F.col("document_id").alias("document"), "page").distinct()
    sections = leaf_sections(layouts, lines)
    chunks = chunking.chunks_of_sections(sections, pages.withColumnRenamed("document_id", "document"), excluded)
    return Parts(pages, staged(tables.series_terms(cells), "chain-terms"), sections, assembly.prose_chunks(chunks))


def documents(made: Parts, skip: bool = False) -> DataFrame:
    """Nested documents. A document without series fails the whole call with a RuntimeError, or with `skip` is left out."""
    if not skip:
        without = [r["document_id"] for r in assembly.without_series(made.terms, made.pages).orderBy("document_id").limit(5).collect()]
        if without:
            raise RuntimeError(f"no series in the tables of: {', '.join(without)} (the first five at most)")
    return assembly.documents(made.terms, made.pages, made.prose)


def chunks(docs: DataFrame) -> DataFrame:
    """One row a chunk, with document_name."""
    return docs.select("document.document_name", F.explode("chunks").alias("c")).select("document_name", "c.*")


def loaded(docs: DataFrame, store: snapshots.Store, vectors: str, embed: vector.Embed | None = None) -> int:
    """Documents into the store and the vectors; the number of the snapshot.

    The nine tables and the graph's vertices and edges change together. Vectors come first: a load that breaks off in between leaves
    chunks of documents that the tables do not know yet, and loading again mends it.
    """
    docs = staged(docs, "chain-documents")
    vertices, edges = canonical.property_graph(docs)
    changes = inbox.changes_of(docs) | {"vertices": snapshots.Change(vertices, ["label", "id"], False), "edges": snapshots.Change(edges, ["source", "type", "target"], True)}
    vector.stored(canonical.payload(chunks(docs)).drop("provenance"), embed or vector.hashing_embedder(), vectors)
    return store.load(changes)


def from_files(store: snapshots.Store, layout_path: str, cell_path: str, vectors: str, embed: vector.Embed | None = None, skip: bool = False) -> int:
    """Layout and cell files to tables, graph and vectors; the number of the snapshot."""
    spark = store.spark
    return loaded(documents(parts(files.layouts(spark, layout_path), files.cells(spark, cell_path)), skip), store, vectors, embed)
