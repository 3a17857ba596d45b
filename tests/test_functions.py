import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import extract, names, text
from ledgerlark.operators import chunking, structure


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("function", "given", "want"), [
    (text.collapsed, " a  b\n", "a b"), (text.collapsed, None, ""), (text.clean_value, "  ", None), (text.heading_key, "A – B....C", "a - b c"),
    (text.entity_key, "A. K. Capital Services Ltd. (formerly X)", "a.k. capital services limited"), (text.slug, "A. K. Capital", "a-k-capital"),
    (text.document_id, "/x/PFC Tranche-I.pdf", "pfc_tranche_i"), (text.document_id, "", "document"), (text.category_name, "I", "Category I"), (text.category_name, "I_II", "Category I and Category II"),
    (text.category_name, "I_II_IV", "Category I, II and IV"), (text.category_name, None, None), (text.category_in_label, "Coupon Cat. II & i", "I_II"), (text.category_in_label, "Coupon", None),
    (text.series_id, "iv*", "IV"), (text.series_id, "abz", None), (text.percentage, "8.5 % p.a.", 8.5), (text.percentage, "N.A.", None), (text.percentage, "x", None),
    (text.amount, "₹ 1,000.50", 1000.5), (text.amount, "—", None), (text.core_name, "Beacon Trusteeship Services Limited", "Beacon Trusteeship"), (text.core_name, "Limited", "Limited"),
    (extract.shelf_limit, "the Shelf Limit, this being Rs. 5,000 crore in all", "Rs. 5,000 crore"), (extract.green_shoe_option, 'up to ₹ 75 crore ("Green Shoe Option")', "₹ 75 crore"),
    (extract.maturity, "Asset Liability Maturity profile 1 year", None), (extract.maturity, "Maturity is 10 years", "10 years"), (extract.maturity, "Redemption Date: March 4, 2030", "March 4, 2030"),
    (extract.issue_name, "tranche ii issue", "Tranche II Issue"), (extract.issue_name, "none", None), (extract.coupon, "8.1% is the Coupon", "8.1%"),
])
def test_columns(spark, function, given, want):
    assert value(spark, function(F.lit(given).cast("string"))) == want


def test_reference_text_is_no_value(spark):
    assert value(spark, text.is_reference_text(F.lit("Please  see page 3")))
    assert not value(spark, text.is_reference_text(F.lit("8 %")))


def test_match_forms_and_mentions(spark):
    assert value(spark, text.match_forms(F.lit("CRISIL Ratings Limited"))) == ["CRISIL Ratings Limited", "CRISIL Ratings", "CRISIL"]
    assert value(spark, text.mentions(F.lit("did crisil rate it?"), F.lit("CRISIL")))
    assert not value(spark, text.mentions(F.lit("crisils"), F.lit("CRISIL")))


def test_company_names():
    found = lambda t: [n for _, _, n in names.company_names(t)]
    assert found("by Nuvama Wealth Management Limited, A. K. Capital Services Limited and Tipsons Consultancy Services Private Limited") == ["Nuvama Wealth Management Limited", "A. K. Capital Services Limited", "Tipsons Consultancy Services Private Limited"]
    assert found("SAVE TO THE LIMITED EXTENT") == []
    assert found("Power Finance Corporation Limited") == ["Power Finance Corporation Limited"]
    assert found("National e-Governance Services Limited") != ["Services Limited"]
    assert found("between the Company and Beacon Trusteeship Limited") == ["Beacon Trusteeship Limited"]


def test_company_names_at_the_edges():
    found = lambda t: [n for _, _, n in names.company_names(t)]
    assert found("signed by Alpha Beta Private Limited.") == ["Alpha Beta Private Limited"]
    assert found("(“Alpha” or Gamma Pvt. Ltd.;") == ["Gamma Pvt. Ltd"]
    assert found("Gamma Corp and Delta Trust LLP, Omega Inc") == ["Gamma Corp and Delta Trust LLP", "Omega Inc"]
    assert found("CRISIL Ratings CRISIL Ratings Limited") == ["CRISIL Ratings Limited"]
    assert found("The Limited. Services Limited Our Private Limited") == []
    assert found("A1 Limited 360 ONE Prime Limited") == ["360 ONE Prime Limited"]
    text = "between the Company and Beacon Trusteeship Limited, here"
    (a, b, name), = names.company_names(text)
    assert text[a:b] == "and Beacon Trusteeship Limited," and name == "Beacon Trusteeship Limited"
    assert found("ONE " * 20_000 + "Limited") == [] and found("") == []


def test_labels_ignore_zone_and_preceding_label():
    page = "Lead Managers Nuvama Wealth Management Limited, Trust Investment Advisors Private Limited Debenture Trustee Beacon Trusteeship Limited Registrar to the Issue KFIN Technologies Limited"
    found = dict((n, k) for k, n in names.labelled_names(page))
    assert found["Trust Investment Advisors Private Limited"] == "Lead Manager"
    assert found["Beacon Trusteeship Limited"] == "Debenture Trustee"
    assert "KFIN Technologies Limited" not in found


def test_rating_letters_and_aliases():
    letter = 'rated "ICRA AA (Stable)" for an amount of ₹ 500 crore by ICRA Limited vide its rating letter dated May 1, 2024'
    assert names.rating_letters(letter)[0] | {"source_text": ""} == {"agency": "ICRA Limited", "rating": "ICRA AA (Stable)", "outlook": "Stable", "rating_date": "May 1, 2024", "source_text": ""}
    assert names.aliases('"CRISIL" / "CRISIL Ratings" CRISIL Ratings Limited') == {"crisil": "CRISIL Ratings Limited", "crisil ratings": "CRISIL Ratings Limited"}


def test_split_and_pack():
    body = "word " * 2000
    pieces = chunking.split_text(body)
    assert all(len(p) <= 3500 for p in pieces) and pieces[0].split()[0] == "word" and len(pieces) == 4
    assert chunking.split_text("x" * 4000)[1] == "x" * 800
    assert [(a, b) for a, b, _ in chunking.windows([(1, "a" * 3000), (2, "b" * 500), (3, "c")])] == [(1, 2), (3, 3)]
    packed = chunking.section_chunks([(1, "a" * 3000), (2, "b" * 600), (3, ""), (4, "c" * 4000)])
    assert packed[0][:2] == (1, 1) and packed[1][2].startswith("a" * 300) and packed[1][:2] == (1, 2)
    assert packed[-1][:2] == (4, 4)
    overlap_goes = chunking.section_chunks([(1, "a" * 3000), (2, "b" * 3400)])
    assert overlap_goes[1][2] == "b" * 3400


def test_contents_levels_and_claims():
    pages = {2: [("TABLE OF CONTENTS", 50.0), ("SECTION I GENERAL ......... 3", 50.0), ("Risk factors that matter", 60.0), ("a lot ..... 12 Our business .... 40", 60.0)]}
    entries = structure.toc_entries(pages)
    assert [(t, p) for t, p, _ in entries] == [("SECTION I GENERAL", 3), ("Risk factors that matter a lot", 12), ("Our business", 40)]
    assert structure.levels([50.0, 52.0, 80.0, 50.5]) == [1, 1, 2, 1]
    heads = [(5, "General"), (14, "Risk factors"), (15, "Risk factors")]
    assert structure.page_offset([("Risk factors", 12)], heads) == 2
    got = structure.resolved([("Risk factors", 12), ("Risk factors", 13), ("Nothing like it", 30)], heads, 2)
    assert [(p, c) for p, c, _, _ in got] == [(14, True), (15, True), (32, False)]


def test_windows_of_pages_equal_plain_packing(spark):
    rng = random.Random(5)
    rows = [(d, p, "x" * n) for d in ("a", "b", None) for p, n in enumerate(rng.choice([0, 1, 7, 900, 1700, 2600, 3499, 3500, 3501, 9000]) for _ in range(150))]
    rows += [("tiny", p, rng.choice("uvw") * rng.randint(1, 40)) for p in range(2000)] + [("a", 200, None), ("tiny", 7, "again"), ("tiny", 7, "again"), ("empty", 1, "")]
    rng.shuffle(rows)
    got = chunking.page_windows(spark.createDataFrame(rows, "document string, page int, text string"), "document", "page", "text")
    want = []
    for d in ("a", "b", None, "tiny", "empty"):
        own = sorted(((p, t or "") for e, p, t in rows if e == d), key=lambda x: (x[0], len(x[1]), x[1]))
        want += [(str(d), i, *w) for i, w in enumerate(chunking.windows(own), 1)]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)


def test_category_name_works_out_its_argument_once(spark):
    rows = spark.createDataFrame([("x Cat. I",), ("Category II & I",), ("category i, ii, iii",), ("none",), (None,)], "label string").withColumn("name", text.category_name(text.category_in_label(F.col("label"))))
    assert [r.name for r in rows.collect()] == ["Category I", "Category I and Category II", "Category I, II and III", None, None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("egory)?") == 1


def test_titles_match_as_by_comparing_all(monkeypatch):
    """Votes and matches by equality and bounds are those of every title against every heading, and fewer are compared."""
    r, tried = random.Random(3), []

    def vote(entries, found, near):
        counts = {}
        for title, printed in entries:
            best, at = -1.0, None
            for page, heading in found:
                if (near is None or abs(page - printed - near) <= 10) and (score := names.similarity(title, heading)) > best:
                    best, at = score, page - printed
            if at is not None and best >= structure.AGREE and -20 <= at <= 20:
                counts[at] = counts.get(at, 0) + 1
        return max(counts, key=counts.get) if counts else None

    def matched(entries, found, offset):
        claimed, out = set(), []
        for title, printed in entries:
            expected = printed + offset
            scored = [(names.similarity(title, h), -abs(p - expected), -k) for k, (p, h) in enumerate(found) if abs(p - expected) <= 3]
            best = max([s for s in scored if -s[2] not in claimed and s[0] >= structure.SAME] or scored, default=None)
            if best and best[0] >= structure.SAME:
                claimed.add(-best[2])
                out.append((found[-best[2]][0], True, round(best[0], 3), found[-best[2]][1]))
            else:
                out.append((expected, False, round(best[0], 3) if best else 0.0, None))
        return out

    ratio = structure.difflib.SequenceMatcher.ratio
    for _ in range(60):
        word = lambda: "".join(r.choice("abc .") for _ in range(r.choice([0, 3, 8, 9, 220])))
        texts = [word() for _ in range(6)]
        found = sorted((r.randint(1, 30), r.choice(texts) + r.choice(["", "", "a"])) for _ in range(r.randint(0, 12)))
        entries = [(r.choice(texts) + r.choice(["", "", "b"]), r.randint(1, 30)) for _ in range(r.randint(0, 8))]
        first = vote(entries, found, None)
        offset = 0 if first is None else vote(entries, found, first) or first
        assert structure.page_offset(entries, found) == offset
        assert structure.resolved(entries, found, offset) == matched(entries, found, offset)
    monkeypatch.setattr(structure.difflib.SequenceMatcher, "ratio", lambda m: tried.append(1) or ratio(m))
    many = [(n, f"heading number {n} of {n * 7919}") for n in range(1, 200)]
    assert structure.page_offset([(t, n) for n, t in many], many) == 0 and not tried


def test_chunks_are_given_while_pages_still_come():
    taken = []
    pages = ((n, taken.append(n) or "word " * 200) for n in range(1, 1001))
    found = chunking.streamed_chunks(pages)
    next(found)
    assert len(taken) < 10
    assert [*found][-1][1] == 1000


def test_labels_are_sought_only_where_a_part_of_them_stands(monkeypatch):
    tried = []

    class Tried:
        def __init__(self, pattern):
            self.pattern = pattern

        def finditer(self, said):
            tried.append(self.pattern.pattern)
            return self.pattern.finditer(said)

    monkeypatch.setattr(names, "_LABELS", [(kind, Tried(pattern), part) for kind, pattern, part in names._LABELS])
    assert names.labelled_names("the LEAD Managers are Nuvama Wealth Management Limited") == [("Lead Manager", "Nuvama Wealth Management Limited")]
    assert tried == [r"Lead\s+Managers?"]
    # letters beyond ASCII that count as i, k and s: every label is tried
    assert names.label_spans("Regıſtrar") == [(0, 9, None)] and len(tried) == 1 + len(names.LABELS)
    letters = [chr(c) for c in range(128, 0x110000) if re.match("[a-z]", chr(c), re.I)]
    assert letters and all(names._FOLDED.match(c) for c in letters)
