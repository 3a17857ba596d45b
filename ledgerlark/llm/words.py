"""Words as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = "\t\n\x0b\x0c\r "


def words(text: Column) -> Column:
    r"""All of [^\x20\x09-\x0D]+ in order; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
