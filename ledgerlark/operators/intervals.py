"""Votes, boundaries, geometry and interval logic, as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators import nesting
from ledgerlark.operators.staging import staged


def most_common(df: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """The value that occurs most often in each group; of equals, the one seen first."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("seen"))
    return counts.groupBy(*by).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("m"), "seen")).alias("b")).select(*by, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"))


def offset_vote(df: DataFrame, by: list[str], offset: str, seq: str, reach: int = 20, near: int = 10) -> DataFrame:
    """Two votes on page offsets: all within the reach, then those near the first winner; a second result of 0 gives the first."""
    votes = df.filter(F.col(offset).between(-reach, reach))
    first = most_common(votes, by, offset, seq).select(*by, F.col(offset).alias("first"))
    close = votes.join(first, by).filter(F.abs(F.col(offset) - F.col("first")) <= near)
    second = most_common(close, by, offset, seq).select(*by, F.col(offset).alias("second"))
    return first.join(second, by, "left").select(*by, F.when(F.coalesce("second", F.lit(0)) != 0, F.col("second")).otherwise(F.col("first")).alias("offset"))


def section_ends(sections: DataFrame, by: str, seq: str, level: str, start: str, last: Column, block: int = nesting.BLOCK) -> DataFrame:
    """A section ends a page before the next one of its level or above; never before its own start; the last at `last`.

    seq are whole numbers, one of its own for each section of a document.
    """
    after = nesting.next_start(sections, by, seq, level, start, block)
    return after.withColumn("end_page", F.when(F.col("_after").isNull(), last).otherwise(F.greatest(F.col(start), F.col("_after") - 1))).drop("_after")


def layout_ends(sections: DataFrame, by: str, seq: str, start: str, last: Column) -> DataFrame:
    """Without levels: up to the page before the next section, at least its own."""
    after = F.lead(start).over(Window.partitionBy(by).orderBy(seq))
    return sections.withColumn("end_page", F.when(after.isNull(), last).otherwise(F.greatest(F.col(start), after - 1)))


def leaves(sections: DataFrame, by: str, seq: str, level: str, start: str = "start_page", end: str = "end_page") -> DataFrame:
    """Sections inside whose pages no deeper section of the document starts: the deepest that starts there is no deeper.

    Pages are halved again and again: every block of 2^k pages knows its deepest start, and a section's pages are at most two
    blocks of each size. Blocks and sections meet by equality, so sections that hold many others make no pairs.
    """
    own = [by, seq, level, start, end]
    sections = staged(sections, "leaves")  # four steps read them
    some = sections.select(*own).dropna(subset=[level, start, end, by]).filter(F.col(end) >= F.col(start))
    span = some.agg(F.max(F.col(end).cast("long") - F.col(start))).first()[0]
    if span is None:
        return sections
    sizes = F.sequence(F.lit(0), F.lit((int(span) + 1).bit_length()))
    page = F.col(start).cast("long")
    deepest = sections.dropna(subset=[by, level, start]).select(by, F.explode(sizes).alias("k"), F.col(level).alias("deep"), page.alias("page"))
    deepest = deepest.groupBy(by, "k", F.expr("shiftright(page, k)").alias("block")).agg(F.max("deep").alias("deep"))
    # at every size: the first block if its number is odd, the last if the one after it is odd
    cut = some.select(*own, F.explode(sizes).alias("k")).withColumn("_lo", F.expr(f"-shiftright(-cast({start} AS BIGINT), k)")).withColumn("_hi", F.expr(f"shiftright(cast({end} AS BIGINT) + 1, k)"))
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    blocks = F.array_compact(F.array(F.when(odd("_lo"), F.col("_lo")), F.when(odd("_hi"), F.col("_hi") - 1)))
    cut = cut.filter("_lo < _hi").select(*own, "k", F.explode(blocks).alias("block"))
    inner = cut.join(deepest, [by, "k", "block"]).filter(F.col("deep") > F.col(level)).select(*own).distinct()
    return sections.join(inner, own, "left_anti")


def section_paths(sections: DataFrame, by: str, seq: str, level: str, title: str, block: int = nesting.BLOCK) -> DataFrame:
    """path: the titles of the ancestors, each the last before with a lower level than all nearer ones, and the own title."""
    return nesting.paths(sections, by, seq, level, title, block)


def merged_spans(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching spans as one."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumn("reach", reach).withColumn("island", island)
    return marked.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def nearest_label(names: DataFrame, labels: DataFrame, by: str, weight: tuple[int, int] = (15, 100), reach: int = 180) -> DataFrame:
    """Each name (name_id, centre) with the label (label_order, label_type, midpoint) of least effective distance in its group.

    Labels at or before the centre count `weight` of their distance, a fraction of whole numbers, so equal distances are equal.
    Of equal ones the first by label_order wins, then the least type, nulls first, then the nearer. The name is dropped if the
    winner's type is null or its plain distance exceeds the reach. Rows of one name_id are names of their own.

    A name meets two labels only, the last at or before it and the first after it, in one order of places, read forwards and
    backwards. No label farther back than reach / weight, or farther ahead than the reach, can decide, so groups are cut into
    stretches of that length: a label stands in its own and in both neighbours.
    """
    part, whole = weight
    stretch = -(-reach * whole // part) + 1
    marks = labels.dropna(subset=[by, "midpoint"]).groupBy(by, F.col("midpoint").alias("at")).agg(F.min(F.struct("label_order", "label_type")).alias("label"))
    cell = lambda c: F.floor(F.col(c) / stretch)
    marks = marks.select(by, F.explode(F.sequence(cell("at") - 1, cell("at") + 1)).alias("cell"), "at", F.struct("at", "label").alias("mark"))
    rows = names.dropna(subset=[by, "centre"]).select(by, cell("centre").alias("cell"), F.col("centre").alias("at"), "name_id")
    both = marks.unionByName(rows, allowMissingColumns=True)
    group = Window.partitionBy(by, "cell")  # a label at a name's place comes before the name
    before = F.last("mark", ignorenulls=True).over(group.orderBy("at", F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("mark", ignorenulls=True).over(group.orderBy(F.desc("at"), F.col("mark").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("before", before).withColumn("after", after).filter("mark IS NULL")

    def candidate(side: str, times: int) -> Column:
        far = F.abs(F.col("at") - F.col(f"{side}.at"))
        label = F.col(f"{side}.label")
        return F.when(F.col(side).isNotNull(), F.struct((far * times).alias("effective"), label["label_order"].alias("o"), label["label_type"].alias("label_type"), far.alias("distance")))

    best = F.array_min(F.array_compact(F.array(candidate("before", part), candidate("after", whole))))
    won = found.select(by, "name_id", best.alias("b")).select(by, "name_id", F.col("b.label_type").alias("label_type"), F.col("b.distance").alias("distance"))
    return won.filter(F.col("label_type").isNotNull() & (F.col("distance") <= reach))


def cells_in_ranges(points: DataFrame, ranges: DataFrame, by: str, at: Column, low: Column, high: Column) -> DataFrame:
    """Points and the closed ranges of their group that hold them.

    A range stands in the cells of the least power of two that is no shorter than it, two at most; a point in one cell of each
    such size that its group's ranges have. They meet by cell, so a large group makes no product.
    """
    keyed = ranges.withColumn("_low", low.cast("double")).withColumn("_high", high.cast("double")).filter("_low <= _high")
    keyed = keyed.withColumn("_size", F.ceil(F.log2(F.greatest(F.col("_high") - F.col("_low"), F.lit(2.0**-20)))))
    place = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "_size"))
    sizes = keyed.groupBy(by).agg(F.collect_set("_size").alias("_sizes"))  # a few for each group
    keyed = keyed.withColumn("_cell", F.explode(F.sequence(place("_low"), place("_high")))).drop("_low", "_high")
    dealt = points.withColumn("_at", at.cast("double")).join(sizes, by).withColumn("_size", F.explode("_sizes")).withColumn("_cell", place("_at")).drop("_sizes", "_at")
    return dealt.join(keyed, [by, "_size", "_cell"]).filter(at.between(low, high)).drop("_size", "_cell")


def hoisted(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """For each group, the columns whose value is the same and not null on all its rows; others are null."""
    same = lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    return rows.groupBy(by).agg(*[same(c) for c in columns])


def merged_lists(rows: DataFrame, by: str, pages: str) -> DataFrame:
    """Sorted distinct union of arrays of each group."""
    return rows.groupBy(by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pages)))).alias(pages))
