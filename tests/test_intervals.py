"""Interval operators against brute force: ties, repeated ids, nulls, many blocks, one large group."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import intervals


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr)


def best_label(centre, labels):
    found = []
    for order, kind, middle in labels:
        far = abs(centre - middle)
        found.append((far * 15 if middle <= centre else far * 100, order, kind is not None, kind or "", far, kind))
    return min(found)[-2:] if found else (None, None)


def test_nearest_label(spark):
    rng = random.Random(1)
    names = [(k, rng.randint(0, 20), rng.randint(0, 600) * 5) for k in range(12) for _ in range(60)] + [(3, 1, 100), (3, 1, 100), (4, None, 50), (None, 1, 5), (5, 1, None)]
    names += [(99, i, rng.randint(0, 40_000)) for i in range(3000)]  # one large group
    labels = [(k, rng.randint(0, 5), rng.choice(["A", "B", None]), rng.randint(0, 600) * 5) for k in range(11) for _ in range(rng.randint(0, 40))] + [(3, 2, "Z", 100), (3, 2, None, 100), (None, 1, "A", 5), (4, 1, "A", None)]
    labels += [(99, rng.randint(0, 9), rng.choice("AB"), rng.randint(0, 40_000)) for _ in range(500)]
    expected = []
    for k, name, centre in names:
        mine = [x[1:] for x in labels if x[0] == k and x[3] is not None]
        if k is None or centre is None or not mine:
            continue
        far, kind = best_label(centre, mine)
        if kind is not None and far <= 180:
            expected.append((k, name, kind, far))
    df = intervals.nearest_label(spark.createDataFrame(names, "k int, name_id int, centre int"), spark.createDataFrame(labels, "k int, label_order int, label_type string, midpoint int"), "k")
    same(df.select("k", "name_id", "label_type", "distance"), expected)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def sections_of(rng, docs, n, levels=4):
    rows = []
    for d in docs:
        page = 1
        for i in range(rng.randint(1, n)):
            page += rng.choice([0, 0, 1, 3])
            rows.append((d, i * 3 - 7, rng.choice([None, *range(1, levels + 1)] if rng.random() < 0.05 else range(1, levels + 1)), page, f"t{d}-{i}"))
    return rows


SECTIONS = "d int, seq int, level int, start_page int, title string"


@pytest.mark.parametrize("block", [5, 64, 1 << 16])
def test_ends_and_paths(spark, block):
    rows = sections_of(random.Random(2), [1, 2, 3, None], 300)
    ends, paths = [], []
    for d in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == d]
        for i, (_, seq, level, start, title) in enumerate(mine):
            after = next((r[3] for r in mine[i + 1 :] if level is not None and r[2] is not None and r[2] <= level), None)
            ends.append((d, seq, 999 if after is None else max(start, after - 1)))
            low, path = 1 << 30, []
            for r in reversed(mine[: i + 1]):
                if r[2] is not None and r[2] < low:
                    low, path = r[2], [r[4], *path]
            paths.append((d, seq, path))
    table = spark.createDataFrame(rows, SECTIONS)
    same(intervals.section_ends(table, "d", "seq", "level", "start_page", F.lit(999), block).select("d", "seq", "end_page"), ends)
    same(intervals.section_paths(table, "d", "seq", "level", "title", block).select("d", "seq", "path"), paths)


def test_one_document_of_many_sections(spark):
    n = 100_000
    table = spark.range(n).selectExpr("1 AS d", "int(id) AS seq", "int(1 + (id * 2654435761) % 7) AS level", "int(id) AS start_page", "string(id) AS title")
    rows = table.select("seq", "level").orderBy("seq").collect()
    stack, ends = [], {}
    for seq, level in reversed(rows):
        while stack and stack[-1][0] > level:
            stack.pop()
        ends[seq] = stack[-1][1] - 1 if stack else n
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, seq))
    found = intervals.section_ends(table, "d", "seq", "level", "start_page", F.lit(n), 4096)
    assert {r.seq: r.end_page for r in found.select("seq", "end_page").collect()} == {s: max(s, e) for s, e in ends.items()}


def test_leaves(spark):
    rng = random.Random(3)
    rows = [(d, s, lv, p, p + rng.choice([0, 0, 1, 5, 40, -1])) for d, s, lv, p, _ in sections_of(rng, [1, 2, None], 250)] + [(1, 900, 1, 0, 5000), (1, 901, 9, 17, 17), (2, 900, 1, None, 4), (2, 901, 1, 3, None), (2, 902, 0, -9, 60)]
    leaf = lambda a: not any(a[0] is not None and b[0] == a[0] and None not in (a[2], a[3], a[4], b[2], b[3]) and b[2] > a[2] and a[3] <= b[3] <= a[4] for b in rows)
    df = intervals.leaves(spark.createDataFrame(rows, "d int, seq int, level int, start_page int, end_page int"), "d", "seq", "level")
    same(df, [r for r in rows if leaf(r)])
    assert intervals.leaves(spark.createDataFrame([], "d int, seq int, level int, start_page int, end_page int"), "d", "seq", "level").count() == 0


def test_cells_in_ranges(spark):
    rng = random.Random(4)
    points = [(g, i, rng.uniform(-50, 600)) for g in (1, 2) for i in range(400)] + [(1, 900, 10.0), (1, 901, 20.0), (1, 902, None), (None, 1, 10.0)]
    ranges = [(g, i, a := rng.uniform(-50, 600), a + rng.choice([0, 0.5, 8, 8.5, 300])) for g in (1, 2, 3) for i in range(200)] + [(1, 900, 10.0, 20.0), (1, 901, 20.0, 10.0), (1, 902, None, 3.0), (1, 903, 10.0, 10.0)]
    expected = [(g, p, r) for g, p, at in points for h, r, low, high in ranges if g is not None and g == h and None not in (at, low, high) and low <= at <= high]
    df = intervals.cells_in_ranges(spark.createDataFrame(points, "g int, p int, at double"), spark.createDataFrame(ranges, "g int, r int, low double, high double"), "g", F.col("at"), F.col("low"), F.col("high"))
    same(df.select("g", "p", "r"), expected)


def test_a_large_group_makes_no_product(spark):
    n = 100_000
    points, ranges = spark.range(n).selectExpr("1 AS g", "id AS p", "double(id) AS at"), spark.range(n).selectExpr("1 AS g", "id AS r", "id - 0.25 AS low", "id + 0.25 AS high")
    assert intervals.cells_in_ranges(points, ranges, "g", F.col("at"), F.col("low"), F.col("high")).filter("p = r").count() == n
