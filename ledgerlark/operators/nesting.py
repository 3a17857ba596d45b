"""Nested sections by a stack of open ones: one pass over a document's sections, in blocks of their sequence.

A section closes all open ones of its level and deeper and is then open itself, so the levels of the open ones rise. A block of
sections needs to know only what is open where it begins. Where documents have more than one block, a first pass
finds what each block leaves open by itself, a second joins these from block to block: the open ones above the block's lowest
level stay, and the block's own follow. Rows stream through the passes sorted; a task holds one stack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Numbers of the sequence in a block.
BLOCK = 1 << 16


def _closed(levels: list, values: list, level: int) -> None:
    while levels and levels[-1] >= level:
        levels.pop()
        values.pop()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _left_open(rows: Iterator[tuple]) -> Iterator[tuple]:
    """by, block, levels and values of what a block leaves open by itself. Rows: by, block, level, value."""
    last, levels, values = None, [], []
    for by, block, level, value in rows:
        if (by, block) != last:
            if last is not None:
                yield (*last, levels, values)
            last, levels, values = (by, block), [], []
        _closed(levels, values, level)
        levels.append(level)
        values.append(value)
    if last is not None:
        yield (*last, levels, values)


def _carried(rows: Iterator[tuple]) -> Iterator[tuple]:
    """by, block, levels and values of what is open where a block begins. Rows: by, block, levels, values."""
    last, levels, values = None, [], []
    for by, block, own, held in rows:
        if by != last:
            last, levels, values = by, [], []
        yield by, block, levels.copy(), values.copy()
        _closed(levels, values, own[0])
        levels += own
        values += held


def _next(rows: Iterator[tuple]) -> Iterator[object]:
    """For each row the value of the section that closes it, from the last to the first. Rows: by, block, level, value, levels, held."""
    last, levels, values = None, [], []
    for by, block, level, value, begun, held in rows:
        if (by, block) != last:
            last, levels, values = (by, block), [], []
        if begun is not None:
            levels, values = begun, held
            yield None
        elif level is None:
            yield None
        else:
            _closed(levels, values, level + 1)
            yield values[-1] if values else None
            _closed(levels, values, level)
            levels.append(level)
            values.append(value)


def _path(rows: Iterator[tuple]) -> Iterator[object]:
    """For each row the values of all open sections, its own last. Rows as above."""
    last, levels, values = None, [], []
    for by, block, level, value, begun, held in rows:
        if (by, block) != last:
            last, levels, values = (by, block), [], []
        if begun is not None:
            levels, values = begun, held
        elif level is not None:
            _closed(levels, values, level)
            levels.append(level)
            values.append(value)
        yield values.copy()


def _added(batches: Iterator[pa.RecordBatch], fold: Callable, result: pa.Field) -> Iterator[pa.RecordBatch]:
    """The batches' own rows and columns with the fold's result; the last six columns are the fold's."""
    waiting: list[tuple] = []
    results = fold(iter(waiting.pop, None))
    for batch in batches:
        found = []
        for row in zip(*(c.to_pylist() for c in batch.columns[-6:])):
            waiting.append(row)
            found.append(next(results))
        own = pa.RecordBatch.from_arrays([*batch.columns[:-6], pa.array(found, result.type)], [*batch.schema.names[:-6], result.name])
        yield own.filter(batch.column(batch.num_columns - 2).is_null())


def _folded(rows: DataFrame, by: str, seq: str, level: str, value: str, fold: Callable, result: str, block: int, backwards: bool) -> DataFrame:
    """rows with `result`, by the fold over their document from the first or from the last section."""
    kinds, spark = dict(rows.dtypes), rows.sparkSession
    place = F.floor(F.col(seq) / block)
    way = F.desc(seq) if backwards else F.asc(seq)
    lists = f"_by {kinds[by]}, _block long, _levels array<bigint>, _held array<{kinds[value]}>"
    schema = lambda ddl: spark.createDataFrame([], ddl).schema

    def passed(df: DataFrame, step: Callable) -> DataFrame:
        arrow = to_arrow_schema(schema(lists))
        return df.mapInArrow(lambda it: _batches(step(_rows(it)), arrow), lists)

    keyed = rows.select("*", F.col(by).alias("_by"), (-place if backwards else place).alias("_block"), F.col(level).cast("long").alias("_level"), F.col(value).alias("_value"))
    keyed = keyed.withColumn("_levels", F.lit(None).cast("array<bigint>")).withColumn("_held", F.lit(None).cast(f"array<{kinds[value]}>"))
    ends = rows.agg(F.min(place).alias("low"), F.max(place).alias("high")).first()
    both = keyed
    if ends["low"] is not None and (ends["low"], ends["high"]) != (0, 0):  # else every document lies in one block, before which nothing is open
        some = keyed.filter("_level IS NOT NULL").select("_by", "_block", "_level", "_value", F.col(seq))
        left = passed(some.repartition("_by", "_block").sortWithinPartitions("_by", "_block", way).select("_by", "_block", "_level", "_value"), _left_open)
        heads = passed(left.repartition("_by").sortWithinPartitions("_by", "_block"), _carried)
        both = keyed.unionByName(heads, allowMissingColumns=True)
    both = both.repartition("_by", "_block").sortWithinPartitions("_by", "_block", F.col("_levels").isNull(), way)
    own = f"{result} array<{kinds[value]}>" if fold is _path else f"{result} {kinds[value]}"
    field = to_arrow_schema(schema(own)).field(0)
    out = StructType([*rows.schema.fields, *schema(own).fields])
    return both.mapInArrow(lambda it: _added(it, fold, field), out)


def next_start(sections: DataFrame, by: str, seq: str, level: str, start: str, block: int = BLOCK) -> DataFrame:
    """sections with _after: where the next one of its level or above starts; null without one, or without a level."""
    return _folded(sections, by, seq, level, start, _next, "_after", block, True)


def paths(sections: DataFrame, by: str, seq: str, level: str, title: str, block: int = BLOCK) -> DataFrame:
    """sections with path: the values of `title` of the open sections, from the outermost to itself."""
    return _folded(sections, by, seq, level, title, _path, "path", block, False)
