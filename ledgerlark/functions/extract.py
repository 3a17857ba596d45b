"""Facts of a page text by pattern: Column -> Column, null where the page does not state the fact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import QUOTES, collapsed

# What prospectuses write.
CURRENCY = r"(?:₹|Rs\.?|INR)\s*[\d,]+(?:\.\d+)?\s*(?:crore|lakh|million|billion)?"
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
WEEKDAY = "(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
DATE = rf"(?:{WEEKDAY},?\s+)?{MONTH}\s+\d{{1,2}},?\s*\d{{4}}"
OUTLOOKS = ["Stable", "Positive", "Negative", "Rating Watch", "Under Review", "Developing"]


def _first(text: Column, *patterns: str, flags: str = "(?iU)") -> Column:
    """The first group of the first pattern that matches, white space collapsed."""
    return F.coalesce(*[F.nullif(collapsed(F.regexp_extract(text, flags + p, 1)), F.lit("")) for p in patterns])


def base_issue_size(text: Column) -> Column:
    return _first(text, rf"Base Issue Size\s*(?:[:\-]\s*)?({CURRENCY})")


def face_value(text: Column) -> Column:
    return _first(text, "face value\\s*(?:of|:)?\\s*(₹?\\s*[\\d,]+)")


def coupon(text: Column) -> Column:
    return _first(text, r"(?:Coupon|Interest Rate)[^%]{0,100}?(\d+(?:\.\d+)?\s*%)", r"(\d+(?:\.\d+)?\s*%)[^%]{0,100}?(?:Coupon|Interest Rate)")


def security_cover(text: Column) -> Column:
    return _first(text, r"(?:Minimum\s+)?Security Cover.{0,150}?(\d+(?:\.\d+)?\s*%)")


def maturity(text: Column) -> Column:
    return _first(text, rf"(?:Maturity Date|Redemption Date).{{0,150}}?({MONTH}\s+\d{{1,2}},?\s+\d{{4}})", r"(?<!Liability )(?:Maturity|Redemption)(?!\s+Profile).{0,100}?(\d+\s*(?:years?|months?))")


def isins(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z]{2}[A-Z0-9]{9}[0-9])\b"), F.lit(1))


def open_date(text: Column) -> Column:
    return _first(text, rf"Issue\s+Opens?\s+on\s*:?\s*({DATE})")


def close_date(text: Column) -> Column:
    return _first(text, rf"Issue\s+Closes?\s+on\s*:?\s*({DATE})")


def document_date(text: Column) -> Column:
    return _first(text, rf"this\s+(?:tranche\s+[ivxlcdm]+\s+)?prospectus\s+dated\s+({DATE})")


def issue_name(text: Column) -> Column:
    number = _first(text, r"TRANCHE\s+([IVXLCDM]+)\s+ISSUE\b")
    return F.when(number.isNotNull(), F.concat(F.lit("Tranche "), F.upper(number), F.lit(" Issue")))


def shelf_limit(text: Column) -> Column:
    return _first(text, rf"Shelf\s+Limit\s*(?:of)?\s*({CURRENCY})", rf"(?s)Shelf\s+Limit.{{0,100}}?being,?\s*({CURRENCY})")


def green_shoe_option(text: Column) -> Column:
    return _first(text, rf"Green\s+Shoe\s+Option\s*(?:of)?\s*({CURRENCY})", rf"({CURRENCY})\s*\([{QUOTES}]\s*Green\s+Shoe\s+Option\s*[{QUOTES}]\)")


def listing(text: Column) -> Column:
    """struct<exchange, exchange_alias>; null where no listing is stated. Case matters here."""
    pattern = "(?U)listed on the\\s+([A-Z][\\w .]+?(?:Limited|Ltd\\.?))(?:\\s*\\([\"“]([A-Za-z0-9 .&'-]{1,20})[\"”]\\))?"
    name = F.nullif(collapsed(F.regexp_extract(text, pattern, 1)), F.lit(""))
    alias = F.nullif(collapsed(F.regexp_extract(text, pattern, 2)), F.lit(""))
    return F.when(name.isNotNull(), F.struct(name.alias("exchange"), alias.alias("exchange_alias")))


def rating_grades(text: Column) -> Column:
    """Every quoted text shortly after `rated`."""
    pattern = "(?iU)\\brated[^\"'“”‘’]{0,40}[\"'“‘](.{3,60}?)[\"'”’]"
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), collapsed)


def grade_parts(block: Column) -> Column:
    """struct<rating, outlook>: quotes and pronunciation asides dropped, the first outlook word named."""
    bare = F.trim(F.regexp_replace(F.btrim(collapsed(block), F.lit(" \t\n" + QUOTES)), r"(?iU)\(\s*pronounced.*?\)", ""))
    outlook = F.coalesce(*[F.when(bare.rlike(rf"(?iU)\b{w}\b"), w) for w in OUTLOOKS])
    return F.struct(bare.alias("rating"), outlook.alias("outlook"))
