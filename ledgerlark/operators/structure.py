"""Document structure: visible tables of contents, levels, headings, and which heading each entry means. One document a group."""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlark.functions.names import heading_key
from ledgerlark.operators import intervals
from ledgerlark.operators.staging import staged

ENTRY = re.compile(r"(.+?)(?:(?:\.\s*){2,}|\s{2,})(\d{1,4})(?=\s|$)")
FIRST, LAST, SAME, AGREE = 2, 6, 0.65, 0.80


def headings(lines: DataFrame, body: DataFrame, band: float = 0.08) -> DataFrame:
    """Lines that may be headings: outside the page's upper and lower band, 3 to 180 characters, larger than the body text or bold.

    body: document, body_size. bbox is (x0, y0, x1, y1)."""
    size = F.char_length(F.trim("text"))
    inside = (F.col("bbox")[1] >= band * F.col("page_height")) & (F.col("bbox")[3] <= (1 - band) * F.col("page_height"))
    return lines.join(body, "document").filter(inside & size.between(3, 180) & ((F.col("size") >= F.col("body_size") + 1.5) | F.col("bold")))


def strongest(found: DataFrame, n: int = 40) -> DataFrame:
    """The n largest (then bold, then first) headings of each document, back in page order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("document").orderBy(F.desc("size"), F.desc("bold"), "page_number", "line_no"))
    return found.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def toc_entries(pages: dict[int, list[tuple[str, float]]]) -> list[tuple[str, int, float]]:
    """(title, printed page, x0) from pages FIRST to LAST, up to the first missing one; a wrapped title is carried to the next line."""
    out, carry, left = [], "", None
    for number in range(FIRST, LAST + 1):
        if number not in pages:
            break
        for line, x0 in pages[number]:
            line = line.strip()
            if not line:
                continue
            if line.upper() == "TABLE OF CONTENTS":
                carry, left = "", None
                continue
            found = list(ENTRY.finditer(line))
            if not found:
                carry, left = f"{carry} {line}".strip(), x0 if left is None else left
                continue
            end = 0
            for k, m in enumerate(found):
                title = m[1] if k == 0 else line[end : m.start(2)].rstrip(". ")
                at = x0
                if k == 0 and carry:
                    title, at = f"{carry} {title}", left
                title = re.sub(r"\s+", " ", re.sub(r"\.{2,}", " ", title)).strip()
                if len(title) > 3:
                    out.append((title, int(m[2]), round(at, 1)))
                carry, left, end = "", None, m.end()
            if rest := line[end:].strip():
                carry, left = rest, x0
    return out


def levels(places: list[float], gap: float = 5.0) -> list[int]:
    """The group, from 1, of each indentation: sorted values join the last group while within gap of its mean; then the nearest value's group."""
    groups: list[list[float]] = []
    for x in sorted(set(places)):
        if groups and abs(x - sum(groups[-1]) / len(groups[-1])) <= gap:
            groups[-1].append(x)
        else:
            groups.append([x])
    known = [(x, i) for i, g in enumerate(groups, 1) for x in g]
    return [min(known, key=lambda k: abs(k[0] - p))[1] for p in places]


class Headings:
    """The heading keys of a document's texts, each with its matcher, made once and only if equality and bounds do not decide."""

    def __init__(self, texts: list[str | None]):
        self.keys = [heading_key(t) for t in texts]
        self.matchers: dict[str, difflib.SequenceMatcher] = {}
        self.at: dict[str, list[int]] = {}
        for i, k in enumerate(self.keys):
            self.at.setdefault(k, []).append(i)

    def equal(self, key: str) -> list[int]:
        """Whose key is the same: these alone are wholly similar. Of long texts the matcher leaves out frequent letters, so they are not told here."""
        return self.at.get(key, []) if len(key) < 200 else []

    def similarity(self, key: str, i: int, more_than: float = -1.0) -> float:
        """names.similarity of the key and text i; -1 where it is no more than the bound."""
        own = self.keys[i]
        if own not in self.matchers:
            self.matchers[own] = difflib.SequenceMatcher(None, "", own)
        m = self.matchers[own]
        m.set_seq1(key)
        if m.real_quick_ratio() <= more_than or (more_than >= 0 and m.quick_ratio() <= more_than):
            return -1.0
        return m.ratio()

    def most(self, key: str, among: list[int]) -> float:
        """The greatest similarity to any of these; 0 without one."""
        best = 0.0
        for i in among:
            best = max(best, self.similarity(key, i, best))
        return best


def _vote(entries: list[tuple[str, int]], found: list[tuple[int, str]], near: int | None, heads: Headings) -> int | None:
    counts: dict[int, int] = {}
    for title, printed in entries:
        key = heading_key(title)
        fits = lambda i: near is None or abs(found[i][0] - printed - near) <= 10  # noqa: B023, E731
        best, at = -1.0, next((found[i][0] - printed for i in heads.equal(key) if fits(i)), None)
        if at is not None:
            best = 1.0
        else:
            for i, (page, _) in enumerate(found):
                if fits(i):
                    score = heads.similarity(key, i, max(best, AGREE - 0.001))  # below AGREE nothing counts
                    if score > best:
                        best, at = score, page - printed
        if at is not None and best >= AGREE and -20 <= at <= 20:
            counts[at] = counts.get(at, 0) + 1
    return max(counts, key=counts.get) if counts else None


def page_offset(entries: list[tuple[str, int]], found: list[tuple[int, str]], heads: Headings | None = None) -> int:
    """By how many pages printed and file numbers differ: two votes, the second near the first; 0 from the second means the first."""
    heads = heads or Headings([h for _, h in found])
    first = _vote(entries, found, None, heads)
    return 0 if first is None else _vote(entries, found, first, heads) or first


def resolved(entries: list[tuple[str, int]], found: list[tuple[int, str]], offset: int, reach: int = 3, heads: Headings | None = None) -> list[tuple[int, bool, float, str | None]]:
    """(page, confirmed, similarity, heading) of each entry in order; a heading once confirmed goes to others only if nothing else fits."""
    heads = heads or Headings([h for _, h in found])
    on: dict[int, list[int]] = {}
    for k, (p, _) in enumerate(found):
        on.setdefault(p, []).append(k)
    claimed: set[int] = set()
    out = []
    for title, printed in entries:
        expected, key = printed + offset, heading_key(title)
        best = max(((1.0, -abs(found[k][0] - expected), -k) for k in heads.equal(key) if k not in claimed and abs(found[k][0] - expected) <= reach), default=None)
        if best is None:
            scored = [(heads.similarity(key, k), -abs(p - expected), -k) for p in range(expected - reach, expected + reach + 1) for k in on.get(p, [])]
            free = [s for s in scored if -s[2] not in claimed and s[0] >= SAME]
            best = max(free or scored, default=None)
        if best and best[0] >= SAME:
            k = -best[2]
            claimed.add(k)
            out.append((found[k][0], True, round(best[0], 3), found[k][1]))
        else:
            out.append((expected, False, round(best[0], 3) if best else 0.0, None))
    return out


def _listed(table: pa.Table) -> list[tuple]:
    """The rows of (page_number, line_no ...) by page and line, without a line last."""
    return sorted(zip(*(c.to_pylist() for c in table.columns)), key=lambda r: (r[0], r[1] is None, r[1] or 0))


def sections(lines: DataFrame, found: DataFrame) -> DataFrame:
    """document, section_no, level, title, printed_page, resolved_page, confirmed, similarity, matched_text from visible contents and headings.

    lines: document, page_number, line_no, text, bbox; found: headings of the same shape."""
    schema = "document string, section_no int, level int, title string, printed_page int, resolved_page int, confirmed boolean, similarity double, matched_text string"

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        pages: dict[int, list[tuple[str, float]]] = {}
        for number, _, body, bbox in _listed(left.select(["page_number", "line_no", "text", "bbox"])):
            pages.setdefault(int(number), []).append((body or "", float(bbox[0])))
        entries = toc_entries(pages)
        found = [(int(number), body or "") for number, _, body in _listed(right.select(["page_number", "line_no", "text"]))]
        heads, plain = Headings([h for _, h in found]), [(t, p) for t, p, _ in entries]
        depth, offset = levels([x for _, _, x in entries]), page_offset(plain, found, heads)
        rows = [(key[0].as_py(), i, d, t, p, *r) for i, ((t, p), d, r) in enumerate(zip(plain, depth, resolved(plain, found, offset, heads=heads), strict=True), 1)]
        return pa.Table.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)

    some = lines.filter(F.col("page_number").between(FIRST, LAST)).select("document", "page_number", "line_no", "text", "bbox")
    return some.groupBy("document").cogroup(found.select("document", "page_number", "line_no", "text").groupBy("document")).applyInArrow(run, schema)


def confirmed_share(found: DataFrame) -> DataFrame:
    return found.groupBy("document").agg(F.avg(F.col("confirmed").cast("int")).alias("share"))


#: An outline is trusted from this share of confirmed entries on; an entry is confirmed from this similarity on, headings at most so many pages away.
TRUST, CHECKED, NEAR = 0.30, 0.75, 2


def cross_validated(outline: DataFrame, contents: DataFrame, found: DataFrame) -> DataFrame:
    """outline (document, section_no, title, start_page ...) with toc_similarity, layout_similarity and confidence.

    An entry is checked against the titles of the visible contents, wherever they point, and against headings on NEAR pages:
    both confirm it (high), one (medium) or none (low). An outline without contents and headings is low throughout.
    """
    schema = "document string, section_no int, toc_similarity double, layout_similarity double"
    signals = contents.select("document", F.lit(None).cast("int").alias("page"), F.col("title").alias("text")).unionByName(found.select("document", F.col("page_number").cast("int").alias("page"), "text"))

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, own, near = [], [], {}
        heads = Headings(right["text"].to_pylist())
        for i, p in enumerate(right["page"].to_pylist()):
            own.append(i) if p is None else near.setdefault(p, []).append(i)
        named = {heads.keys[i] for i in own}
        for document, no, title, start in zip(*(left[c].to_pylist() for c in ("document", "section_no", "title", "start_page"))):
            key = heading_key(title)
            toc = 1.0 if len(key) < 200 and key in named else heads.most(key, own)
            around = [] if start is None else [i for p in range(start - NEAR, start + NEAR + 1) for i in near.get(p, [])]
            layout = 1.0 if set(heads.equal(key)) & set(around) else heads.most(key, around)
            rows.append({"document": document, "section_no": no, "toc_similarity": toc, "layout_similarity": layout})
        return pa.Table.from_pylist(rows, schema=kind)

    scored = outline.select("document", "section_no", "title", "start_page").groupBy("document").cogroup(signals.groupBy("document")).applyInArrow(run, schema)
    good = (F.col("toc_similarity") >= CHECKED).cast("int") + (F.col("layout_similarity") >= CHECKED).cast("int")
    out = outline.join(scored.hint("merge"), ["document", "section_no"]).withColumn("confidence", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), good + 1))
    return out.withColumn("toc_similarity", F.round("toc_similarity", 3)).withColumn("layout_similarity", F.round("layout_similarity", 3))


def detected(outline: DataFrame, lines: DataFrame, found: DataFrame, totals: DataFrame) -> DataFrame:
    """document, strategy, section_no, level, title, start_page, end_page, confidence by the best evidence of each document.

    outline: document, section_no, level, title, page of the file; totals: document, total_pages; lines and found as in sections().
    The outline where TRUST of its entries are confirmed, else the visible contents, else the strongest headings as flat sections.
    """
    from pyspark.sql import Window

    columns, last = ["document", "strategy", "section_no", "level", "title", "start_page", "end_page", "confidence"], F.col("total_pages")
    # each is read by several steps below, which would all match titles again
    contents = staged(sections(lines, found).withColumnRenamed("resolved_page", "start_page").join(totals.hint("merge"), "document"), "detected-contents")
    own = intervals.section_ends(outline.withColumnRenamed("page", "start_page").join(totals.hint("merge"), "document"), "document", "section_no", "level", "start_page", last)
    own = staged(cross_validated(own, contents, found).withColumn("strategy", F.lit("outline")), "detected-outline")
    trusted = own.groupBy("document").agg(F.avg((F.col("confidence") != "low").cast("int")).alias("share")).filter(F.col("share") >= TRUST).select("document")
    placed = contents.filter(F.col("start_page").between(1, last)).withColumn("section_no", F.row_number().over(Window.partitionBy("document").orderBy("start_page", "section_no")))
    toc = intervals.section_ends(placed, "document", "section_no", "level", "start_page", last).withColumn("strategy", F.lit("contents")).withColumn("confidence", F.lit(None).cast("string"))
    toc = toc.join(trusted, "document", "left_anti")
    strong = strongest(found).select("document", F.lit("layout").alias("strategy"), F.row_number().over(Window.partitionBy("document").orderBy("page_number", F.desc("size"), F.desc("bold"), "line_no")).alias("section_no"), F.lit(1).alias("level"), F.col("text").alias("title"), F.col("page_number").cast("int").alias("start_page"), F.lit("low").alias("confidence"))
    strong = intervals.layout_ends(strong.join(totals, "document"), "document", "section_no", "start_page", last)
    strong = strong.join(trusted.unionByName(contents.select("document")).distinct(), "document", "left_anti")
    return own.join(trusted, "document", "left_semi").select(*columns).unionByName(toc.select(*columns)).unionByName(strong.select(*columns))
