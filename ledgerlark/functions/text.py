"""Text normalisation and labels as Column -> Column functions. White space and case are Unicode's throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
QUOTES = "\"'“”‘’"
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
SUFFIX_WORDS = ("limited", "ltd", "services", "pvt", "private")
REFERENCE_TEXT = r"(please\s+(see|refer)|kindly\s+(see|refer)|refer\s+to|as\s+(mentioned|specified|set\s+out|stated)|see\s+[\"']?issue\s+structure|see\s+(page|section|annexure|para)|refer\s+(page|section|annexure|para)|\bpage\s+no\.?\s*\d+)"
NULL_TOKENS = ["NA", "N/A", "N.A.", "N.A", "-", "—", "--"]


def collapsed(c: Column) -> Column:
    """Runs of white space to one space, trimmed; null gives the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean_value(c: Column) -> Column:
    """As collapsed, but null where nothing is left."""
    return F.nullif(collapsed(c), F.lit(""))


def heading_key(c: Column) -> Column:
    """Lower case, dashes unified, white space collapsed, then dot runs to one space (which may leave two)."""
    flat = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[–—]", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(flat, r"(?U)\s+", " "), r"\.+", " "))


def entity_key(c: Column) -> Column:
    """The form by which two names count as one: no trailing parenthesis or punctuation, initials joined, ltd as limited."""
    bare = F.regexp_replace(collapsed(c), r"\s*\([^)]{0,120}\)\s*$", "")
    bare = F.lower(F.btrim(bare, F.lit(" .,;:\"'")))
    joined = F.regexp_replace(bare, r"\.\s+(?=[a-z]\.)", ".")
    return F.regexp_replace(joined, r"\bltd\.?$", "limited")


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(entity_key(c), "[^a-z0-9]+", "-"), F.lit("-"))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def document_id(path: Column) -> Column:
    """The file's stem in lower case with _ for everything else; `document` if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(_stem(path)), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("document"))


def field_title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def coupon_type(frequency: Column) -> Column:
    """Null stays null; the first rule that holds decides."""
    low = F.lower(frequency)
    return F.when(low.contains("zero coupon"), "Zero Coupon").when(low.contains("cumulative"), "Cumulative").when(frequency.isNotNull(), "Coupon-Bearing")


def category_parts(category_id: Column) -> Column:
    """I_II -> [I, II]; empty parts dropped, null gives none."""
    return F.filter(F.split(F.coalesce(category_id, F.lit("")), "_"), lambda p: p != "")


def category_name(category_id: Column) -> Column:
    """I -> Category I; I_II -> Category I and Category II; more -> Category I, II and III."""

    def named(p: Column) -> Column:
        n = F.size(p)
        many = F.concat(F.lit("Category "), F.array_join(F.slice(p, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.try_element_at(p, F.lit(-1)))
        return F.when(n == 0, None).when(n == 1, F.concat(F.lit("Category "), p[0])).when(n == 2, F.concat(F.lit("Category "), F.get(p, F.lit(0)), F.lit(" and Category "), F.get(p, F.lit(1)))).otherwise(many)

    return F.get(F.transform(F.array(category_parts(category_id)), named), F.lit(0))  # the parts are worked out once, not where they are named


def category_in_label(label: Column) -> Column:
    """Distinct Roman numerals after the first `category` or `cat`, in their order, joined by _; null without any."""
    tail = F.regexp_extract(F.lower(collapsed(label)), r"\bcat(?:egory)?\.?\s*(.*)$", 1)
    found = F.regexp_extract_all(tail, F.lit(r"\b(viii|vii|vi|iv|ix|v|x|iii|ii|i)\b"), F.lit(1))
    order = F.array(*[F.lit(r.lower()) for r in ROMAN])
    return F.nullif(F.upper(F.array_join(F.array_intersect(order, found), "_")), F.lit(""))


def series_id(c: Column) -> Column:
    """Upper case, Roman letters only; null if none is left."""
    return F.nullif(F.regexp_replace(F.upper(c), "[^IVXLCDM]", ""), F.lit(""))


def is_series_cell(c: Column) -> Column:
    return is_series(collapsed(c))


def is_series(flat: Column) -> Column:
    """is_series_cell of a text that is collapsed already; so the next two."""
    return F.coalesce(flat.rlike("^(?i)[IVXLCDM]+[*†‡]*$"), F.lit(False))


def is_series_word(flat: Column) -> Column:
    return F.lower(F.substring(flat, 1, 7)).isin("series", "series ")


def is_reference(flat: Column) -> Column:
    return F.coalesce(flat.rlike("(?iU)" + REFERENCE_TEXT), F.lit(False))


def has_series_word(cells: Column) -> Column:
    low = lambda x: F.lower(collapsed(x))
    return F.exists(cells, lambda x: (low(x) == "series") | low(x).startswith("series "))


def is_reference_text(c: Column) -> Column:
    """The cell sends the reader elsewhere instead of giving a value."""
    return is_reference(collapsed(c))


def _no_value(c: Column) -> Column:
    return c.isNull() | F.replace(F.upper(c), F.lit(" "), F.lit("")).isin(NULL_TOKENS)


def percentage(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?U)(\d+(?:\.\d+)?)\s*%", 1)
    return F.when(_no_value(c), None).otherwise(found.try_cast("double"))


def amount(c: Column) -> Column:
    bare = c
    for mark in ("₹", ",", "INR", "Rs.", "RS."):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    return F.when(_no_value(c), None).otherwise(F.regexp_extract(bare, r"(\d+(?:\.\d+)?)", 1).try_cast("double"))


def core_name(c: Column) -> Column:
    """The name without its trailing corporate words; the first word always stays."""
    return F.regexp_replace(collapsed(c), r"(?i)(?<=\S)(\s+\.*(" + "|".join(SUFFIX_WORDS) + r")\.*)+$", "")


def match_forms(c: Column) -> Column:
    """Full name, core name and, if longer than three characters, the first word."""
    first = F.substring_index(collapsed(c), " ", 1)
    return F.array_distinct(F.filter(F.array(c, core_name(c), F.when(F.char_length(first) > 3, first)), lambda f: f.isNotNull() & (f != "")))


def file_alias(path: Column) -> Column:
    """The first part, before any _, of a file's stem: pfc of pfc_ncd_2026.pdf; null if it has no more than two characters."""
    alias = F.substring_index(_stem(path), "_", 1)
    return F.when(F.char_length(alias) > 2, alias)


def mentions(text: Column, form: Column) -> Column:
    """Whole-word, case-insensitive."""
    return F.regexp_like(text, F.concat(F.lit(r"(?iU)(?<!\w)\Q"), form, F.lit(r"\E(?!\w)")))


def chunk_label(document: Column, page: Column, section: Column, series: Column, category: Column) -> Column:
    """document - page - section, or the series and category where there is no section. Empty parts and page 0 are left out."""
    said = lambda c: F.nullif(c, F.lit(""))
    place = F.coalesce(said(section), said(F.concat_ws(" ", said(series), said(category))))
    return F.concat_ws(" — ", said(document), F.when(page != 0, F.concat(F.lit("p."), page.cast("string"))), place)


def preview(c: Column, size: int = 150) -> Column:
    return F.regexp_replace(F.replace(F.substring(c, 1, size), F.lit("\n"), F.lit(" ")), r"(?U)^\s+|\s+$", "")


def point_id(chunk_id: Column) -> Column:
    """The first 64 bits of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(chunk_id, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def identifier(c: Column) -> Column:
    """A safe label: other characters to _, not starting with a digit."""
    safe = F.regexp_replace(F.trim(c), "[^A-Za-z0-9_]", "_")
    return F.when(safe.rlike("^[0-9]"), F.concat(F.lit("_"), safe)).otherwise(safe)
