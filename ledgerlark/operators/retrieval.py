"""Question to candidates: routing to typed look-ups, vector hits, and the loop that decomposes, retrieves, selects and answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.operators import search, vector
from ledgerlark.operators.staging import staged

# Words that send a question to the issue overview.
OVERVIEW_WORDS = ["trustee", "shelf limit", "green shoe", "rating", "lead manager", "listing", "exchange", "issue size", "security cover", "issue open", "issue close", "allotment"]
SERIES, CATEGORY = r"(?i)\bseries\s+([ivx]+)\b", r"(?i)\bcategor(?:y|ies)\s+([ivx]+)\b"
ROUNDS = 5


def forms(entities: DataFrame, name: str = "name", kind: str = "kind") -> DataFrame:
    """kind, name, form: everything by which a known entity may be called."""
    return entities.select(kind, name, F.explode(text.match_forms(F.col(name))).alias("form")).distinct()


def _met(questions: DataFrame, vocabulary: DataFrame, question: str = "question") -> DataFrame:
    """Rows of the questions' words and the vocabulary where the question holds the form."""
    first = F.lower(F.regexp_extract("form", r"(?U)^\W*(\w+)", 1))
    words = questions.select("question_id", question, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(r"(?U)(\w+)"), F.lit(1)))).alias("_w"))
    return words.join(vocabulary.withColumn("_w", first), "_w").filter(text.mentions(F.col(question), F.col("form")))


def mentioned(questions: DataFrame, vocabulary: DataFrame, question: str = "question", kind: str = "kind", name: str = "name") -> DataFrame:
    """question_id, kind, name: the entity of each kind whose longest form the question holds; the first name on a tie.

    Words of both sides are joined first, so only names that share the form's first word are tested.
    """
    return _met(questions, vocabulary, question).groupBy("question_id", kind).agg(F.min_by(name, F.struct((-F.length("form")).alias("l"), F.col(name))).alias(name))


def routes(question: Column) -> Column:
    """struct<series, category, overview>: what the question names."""
    upper = lambda p: F.nullif(F.upper(F.regexp_extract(question, p, 1)), F.lit(""))
    overview = F.exists(F.array(*map(F.lit, OVERVIEW_WORDS)), lambda w: F.contains(F.lower(question), w))
    return F.struct(upper(SERIES).alias("series"), upper(CATEGORY).alias("category"), overview.alias("overview"))


def candidates(parts: list[DataFrame]) -> DataFrame:
    """source_id, text, label, score of several sources; the earlier source wins an id, then the higher score."""
    every = [p.select("source_id", "text", "label", "score").withColumn("source_rank", F.lit(i)) for i, p in enumerate(parts)]
    out = every[0]
    for p in every[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("source_id").orderBy("source_rank", F.desc("score"), "text")
    return out.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    return found.join(seen.select("source_id"), "source_id", "left_anti")


def _said(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _sentence(head: Column, facts: list[Column]) -> Column:
    """head: fact, fact. - or head alone with its full stop."""
    return F.concat(F.concat_ws(": ", head, F.nullif(F.concat_ws(", ", *facts), F.lit(""))), F.lit("."))


def term_sentence() -> Column:
    """A row of search.bond_terms as a sentence; null and empty facts are left out."""
    number = lambda label, c, unit="": F.concat(F.lit(f"{label} "), F.col(c).cast("string"), F.lit(unit))
    head = F.concat_ws(" Category ", F.concat_ws(" Series ", "issuer", "series_code"), _said("category_code"))
    facts = [
        F.concat(F.lit("tenor "), _said("tenor")), F.concat(_said("coupon_type"), F.coalesce(F.concat(F.lit(" ("), _said("frequency"), F.lit(")")), F.lit(""))), number("face value INR", "face_value_inr"), number("coupon", "coupon_percent", "%"),
        number("effective yield", "effective_yield_percent", "%"), number("issue price INR", "issue_price_inr"), number("maturity amount INR", "maturity_amount_inr"), _said("nature_of_indebtedness"),
    ]
    return _sentence(head, facts)


def issue_sentence() -> Column:
    """A row of search.issue_facts as a sentence."""
    missing = F.lit("None")  # how a date or a rating that is not known is shown beside one that is
    stated = lambda label, c: F.concat(F.lit(f"{label} "), _said(c))
    dates = F.concat(F.lit("open "), F.coalesce("issue_open_date", missing), F.lit(" to "), F.coalesce("issue_close_date", missing))
    rated = F.transform(F.filter("ratings", lambda r: _said(r["agency"]).isNotNull()), lambda r: F.concat(r["agency"], F.lit(": "), F.coalesce(r["rating"], missing)))
    facts = [
        stated("issue size", "issue_size"), stated("debenture trustee", "debenture_trustee"), stated("security type", "security_type"), stated("security cover", "security_cover"), stated("shelf limit", "shelf_limit"),
        stated("green shoe option", "green_shoe_option"), F.concat(F.lit("listed on "), _said("listing"), F.coalesce(F.concat(F.lit(" ("), _said("exchange"), F.lit(")")), F.lit(""))),
        F.when(_said("issue_open_date").isNotNull() | _said("issue_close_date").isNotNull(), dates), F.concat(F.lit("ratings - "), _said(F.array_join(rated, "; "))), F.concat(F.lit("lead managers - "), _said(F.array_join("lead_managers", ", "))),
    ]
    return _sentence(F.concat("issuer", F.lit(" ("), F.coalesce("issue_name", missing), F.lit(")")), facts)


def participant_sentence() -> Column:
    place = F.concat("issuer", F.lit(" ("), F.coalesce("issue_name", F.lit("None")), F.lit(", "), "document_name", F.lit(")"))
    return F.concat(place, F.lit(": "), "participant_name", F.lit(" served as "), "participant_role", F.lit("."))


def vocabulary(facts: DataFrame, involved: DataFrame) -> DataFrame:
    """kind, name, form of all issuers (the first part of their files' names too) and participants of search.issue_facts and participations."""
    issuers = facts.select(F.lit("Issuer").alias("kind"), F.col("issuer").alias("name"), "document_name").filter("name <> ''")
    files = issuers.select("kind", "name", text.file_alias(F.col("document_name")).alias("form")).filter("form IS NOT NULL")
    people = involved.select(F.lit("Participant").alias("kind"), F.col("participant_name").alias("name"))
    return forms(issuers.select("kind", "name").unionByName(people).distinct()).unionByName(files).distinct()


def _starts(name: Column) -> Column:
    """The first three characters in lower case, or all of a shorter name."""
    return F.substring(F.lower(name), 1, 3)


def _containing(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (participant) with the names (participant_name) that contain it, whatever the case: met by three characters, then tested."""
    low = F.lower("participant_name")

    def pieces(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - (n - 1), F.lit(1))), lambda i: F.substring(low, i, n))

    grams = F.array_distinct(F.flatten(F.array(pieces(1), pieces(2), pieces(3))))
    met = asked.withColumn("_g", _starts(F.col("participant"))).join(names.select("participant_name", F.explode(grams).alias("_g")), "_g")
    return met.filter(F.contains(low, F.lower("participant"))).drop("_g")


def _first(rows: DataFrame, by: list[str], order: list[str], cap: int) -> DataFrame:
    """The first cap rows of each group, and all that tie with the last of these."""
    place = F.rank().over(Window.partitionBy(*by).orderBy(*[F.asc_nulls_first(c) for c in order]))
    return rows.withColumn("_p", place).filter(F.col("_p") <= cap).drop("_p")


def _of_issues(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables' rows of some issues (issue_id) and of their documents."""
    ids = search.small(ids.distinct())
    kept = {name: tables[name].join(ids, "issue_id", "left_semi") for name in ("series", "series_category_terms", "series_provenance", "ratings", "lead_managers")}
    issues = staged(tables["issues"].join(ids, F.col("issue_identifier").eqNullSafe(ids["issue_id"]), "left_semi"), "asked-issues")
    return kept | {"issues": issues, "documents": tables["documents"].join(search.small(issues.select("document_name").distinct()), "document_name", "left_semi")}


def structured_candidates(questions: DataFrame, tables: dict[str, DataFrame], cap: int = 200) -> DataFrame:
    """question_id, source_id, text, label, score of the typed look-ups that each question (question_id, question) asks for.

    Terms where it names a series or a category, of its issuer if it names one; the overview where it names an issuer and a word
    of OVERVIEW_WORDS; issues of the participant that it names. Each look-up returns at most cap rows a question, as the tools do.

    What is asked is found first. Then the first cap rows of each thing that is asked, by their keys alone and once however many
    questions ask for it; only the issues of these are read whole. What no question asks for is not looked up.
    """
    issues = staged(search.known_issues(tables), "known-issues")
    names = [tables["issues"].select(F.col("debenture_trustee").alias("participant_name")), tables["lead_managers"].select(F.col("name").alias("participant_name")), tables["ratings"].select(F.col("agency").alias("participant_name"))]
    names = staged(reduce(DataFrame.unionByName, names).filter("participant_name <> ''").distinct(), "participant-names")
    met = staged(_met(questions, forms(names.select(F.lit("Participant").alias("kind"), F.col("participant_name").alias("name")))).select(F.col("name").alias("participant_name")).distinct(), "met-names")
    found = mentioned(questions, vocabulary(issues, search.participations(tables, issues, met)))
    one = lambda kind, name: found.filter(F.col("kind") == kind).select("question_id", F.col("name").alias(name))
    asked = questions.select("question_id", routes(F.col("question")).alias("r")).select("question_id", "r.*")
    asked = staged(asked.join(one("Issuer", "issuer"), "question_id", "left").join(one("Participant", "participant"), "question_id", "left"), "asked")

    def shown(rows: DataFrame, order: list[str], source: Column, section: Column, sentence: Column, kind: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("question_id").orderBy(*[F.asc_nulls_first(c) for c in order], sentence))
        label = F.concat(F.lit(f"[{kind}] "), F.concat_ws(" — ", "document_name", section))
        return rows.withColumn("_n", place).filter(F.col("_n") <= cap).select("question_id", source.alias("source_id"), sentence.alias("text"), label.alias("label"), F.lit(1.0).alias("score"))

    keys = ["series", "category", "issuer"]
    named = staged(asked.select(*keys).distinct(), "asked-terms")
    ways = [[k for k in keys if r[k]] for r in named.select(*[F.col(k).isNotNull().alias(k) for k in keys]).distinct().collect()]  # what a question names, so that every join has keys
    ways = [on for on in ways if "series" in on or "category" in on]
    naming = lambda rows, on: rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() if k in on else F.col(k).isNull() for k in keys])).drop(*[k for k in keys if k not in on])
    picks = []
    for on in ways:
        wanted = search.small(naming(named, on))
        lines, cats = tables["series"].select("issue_id", F.col("series_code").alias("series")), tables["series_category_terms"].select("issue_id", F.col("series_code").alias("series"), F.col("category_code").alias("category"))
        some = {"issuer": issues.select("issue_id", "issuer"), "series": lines, "category": cats}
        for k in on:  # what no such question names goes before the joins
            some[k] = some[k].join(search.small(wanted.select(k).distinct()), k, "left_semi")
        rows = some["series"].join(some["category"], ["issue_id", "series"], "inner" if "category" in on else "left").join(some["issuer"], "issue_id")
        rows = rows.join(wanted, on, "left_semi").withColumn("series_id", F.concat_ws(":", "issue_id", "series"))
        picks.append(_first(rows.select(*keys, "series_id", "issue_id"), on, ["series", "category", "series_id"], cap).select("issue_id"))
    out = []
    if picks:
        terms = search.bond_terms(_of_issues(tables, staged(reduce(DataFrame.unionByName, picks).distinct(), "picked-terms"))).withColumnsRenamed({"series_code": "series", "category_code": "category"})
        legs = [naming(asked.select("question_id", *keys), on).join(terms, on).select("question_id", *terms.columns) for on in ways]
        rows = reduce(DataFrame.unionByName, legs).withColumnsRenamed({"series": "series_code", "category": "category_code"})
        out.append(shown(rows, ["series_code", "category_code", "series_id"], F.concat(F.lit("sql:series:"), "series_id"), F.col("section"), term_sentence(), "SQL"))
    overview = asked.filter("overview AND issuer IS NOT NULL").select("question_id", "issuer")
    rows = issues.select("issuer", "issue_id").join(search.small(overview.select("issuer").distinct()), "issuer", "left_semi")
    facts = search.issue_facts(_of_issues(tables, staged(_first(rows, ["issuer"], ["issue_id"], cap).select("issue_id").distinct(), "picked-issues")))
    out.append(shown(overview.join(facts, "issuer"), ["issue_id"], F.concat(F.lit("sql:issue:"), "issue_id"), F.col("issue_name"), issue_sentence(), "SQL"))
    acting = asked.filter("participant IS NOT NULL").select("question_id", "participant")
    wide = staged(_containing(acting.select("participant").distinct(), names).select("participant", "participant_name").distinct(), "wide-names")
    rows = search.participations(tables, issues, wide.select("participant_name").distinct()).join(search.small(wide), "participant_name")
    order = ["issue_id", "participant_role", "participant_name"]
    rows = acting.join(staged(_first(rows, ["participant"], order, cap), "picked-participations"), "participant")
    source = F.concat_ws(":", F.lit("graph"), "issue_id", "participant_role", "participant_name")
    out.append(shown(rows, order, source, F.col("participant_role"), participant_sentence(), "Graph"))
    return reduce(DataFrame.unionByName, out)


def vector_candidates(questions: DataFrame, chunks: DataFrame, embed: vector.Embed, k: int = 6) -> DataFrame:
    """question_id, source_id, text, label, score, atom: the k nearest chunks of the vector store for each question; atom is the question with label and preview."""
    asked = questions.withColumn("embedding", vector.embedding_of(F.col("question"), embed))
    best = vector.top_k_of_each(asked.select(F.col("question_id").alias("query_id"), "embedding"), chunks, k, key="chunk_id")
    rows = best.select(F.col("query_id").alias("question_id"), F.col("key").alias("chunk_id"), "score").join(chunks, "chunk_id").join(questions.select("question_id", "question"), "question_id")
    label = text.chunk_label(F.col("document_name"), F.col("start_page"), F.col("section_path"), F.col("series_id"), F.col("category_id"))
    rows = rows.withColumn("label", label)
    atom = F.concat("question", F.lit(" ["), "label", F.lit("]: "), text.preview(F.col("text")))
    return rows.select("question_id", F.col("chunk_id").alias("source_id"), "text", "label", "score", atom.alias("atom"))


def reply_value(reply: str) -> object:
    """The JSON value of a model's reply, which may stand in a code fence; None if it is no JSON."""
    fenced = re.search(r"```[\w-]*\s*(.*?)```", reply, re.S)
    try:
        return json.loads(fenced[1] if fenced else reply)
    except ValueError:
        return None


class Model(Protocol):
    def propose(self, question: str, known: list[dict]) -> list[str]: ...

    def select(self, question: str, sub_questions: list[str], found: list[dict]) -> int | None: ...

    def answer(self, question: str, known: list[dict]) -> str: ...


@dataclass
class Trace:
    answer: str = ""
    rounds: list[dict] = field(default_factory=list)
    citations: list[str] = field(default_factory=list)


def answered(question: str, model: Model, retrieve: Callable[[str], list[dict]], rounds: int = ROUNDS, on_round: Callable[[int, str], None] | None = None) -> Trace:
    """Up to `rounds` times: sub-questions, their candidates less those seen, one chosen; then the answer from all chosen."""
    trace, chosen, seen = Trace(), [], set()
    for n in range(1, rounds + 1):
        if on_round:
            on_round(n, "propose")
        asked = model.propose(question, chosen)
        if not asked:
            break
        found = []
        for sub in asked:
            for c in retrieve(sub):
                if c["source_id"] not in seen:
                    seen.add(c["source_id"])
                    found.append({**c, "question": sub})
        pick = model.select(question, asked, found) if found else None
        if pick is None or not 0 <= pick < len(found):
            break
        chosen.append(found[pick])
        seen -= {c["source_id"] for c in found if c is not found[pick]}
        trace.rounds.append({"round": n, "sub_questions": asked, "chosen": found[pick]["source_id"]})
    if on_round:
        on_round(len(chosen) + 1, "answer")
    trace.answer = model.answer(question, chosen)
    trace.citations = [c["source_id"] for c in chosen]
    return trace
