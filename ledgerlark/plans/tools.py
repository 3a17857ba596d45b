"""The read-only tool surface: guarded SQL, envelopes with citations, health."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import graph, search, vector

CAP = 200


@dataclass
class Answer:
    """What a tool returns: rows, citations, whether the cap cut them; or an error and its detail."""

    tool: str
    data: list[dict] = field(default_factory=list)
    citations: list[dict] = field(default_factory=list)
    row_count: int = 0
    truncated: bool = False
    error: str | None = None
    detail: str | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


class Refused(ValueError):
    pass


#: Kinds of built-in functions, as Spark groups them, that a query may use. Calls of Java methods, files' names and the like are in others.
FUNCTIONS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs",
    "string_funcs", "struct_funcs", "window_funcs", "table_funcs",
}
#: Nodes of a parsed query.
NODES = {
    "Aggregate", "CTERelationDef", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sort", "SubqueryAlias",
    "Union", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedWith", "Unpivot", "WithWindowDefinition",
}


def guarded(spark: SparkSession, statement: str) -> DataFrame:
    """The statement's rows if it is one query over known tables: every node of the parsed plan, in subqueries too, is one that
    reads and computes; every function is built in and of a kind that computes; every relation is a table or a view, not a file."""
    state = spark._jsparkSession.sessionState()
    try:
        plan = state.sqlParser().parsePlan(statement)
    except Exception as e:
        raise Refused(f"not one SQL query: {str(e).splitlines()[0]}") from e
    _checked(spark, state, plan, set())
    return spark.sql(statement)


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _checked(spark: SparkSession, state, node, named: set[str]) -> None:
    kind = node.getClass().getSimpleName()
    if kind not in NODES:
        raise Refused(f"only queries are allowed, not {kind}")
    if kind == "UnresolvedWith":
        named = set(named)
        for pair in _each(node.cteRelations()):
            # a later name may use the earlier ones, and a recursive one itself
            named.add(pair._1().lower())
            _checked(spark, state, pair._2(), named)
    if kind == "UnresolvedRelation":
        parts = _each(node.multipartIdentifier())
        known = len(parts) == 1 and parts[0].lower() in named or spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts))
        if not known:
            raise Refused(f"no table {'.'.join(parts)}")
    if kind == "UnresolvedTableValuedFunction":
        _known(spark, state, _each(node.name()))
    for e in _each(node.expressions()):
        _computes(spark, state, e, named)
    for child in _each(node.children()):
        _checked(spark, state, child, named)


def _computes(spark: SparkSession, state, e, named: set[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        _known(spark, state, _each(e.nameParts()))
    elif kind == "UnresolvedGenerator":
        _known(spark, state, [e.name().funcName()])
    elif "CallMethod" in kind or "Invoke" in kind:
        raise Refused(f"{kind} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _checked(spark, state, e.plan(), named)
    for child in _each(e.children()):
        _computes(spark, state, child, named)


def _known(spark: SparkSession, state, parts: list[str]) -> None:
    name = parts[-1].lower()
    try:
        info = state.catalog().lookupFunctionInfo(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        fine = len(parts) == 1 and info.getSource() == "built-in" and (info.getGroup() in FUNCTIONS or name in ("coalesce", "if", "nvl", "range"))
    except Exception:  # no such function
        fine = False
    if not fine:
        raise Refused(f"the function {'.'.join(parts)} is not allowed")


def answered(tool: str, df: DataFrame, source_type: str, source_id: str | None = None, cap: int = CAP) -> Answer:
    """At most cap rows, one more fetched to know whether they were cut; a citation a row."""
    rows = [r.asDict(recursive=True) for r in df.limit(cap + 1).collect()]
    cut = rows[:cap]
    citations = [{"source_type": source_type, "source_id": f"{tool}:{r[source_id]}" if source_id else f"query_result:{i}"} for i, r in enumerate(cut)]
    return Answer(tool, cut, citations, len(cut), len(rows) > cap)


def sql_query(spark: SparkSession, statement: str, citation_table: str | None = None, citation_key: str | None = None, cap: int = CAP) -> Answer:
    try:
        return answered(citation_table or "sql_query", guarded(spark, statement), "sql", citation_key, cap)
    except Refused as e:
        return Answer("sql_query", error="rejected", detail=str(e))
    except Exception as e:
        return Answer("sql_query", error="query_failed", detail=str(e).splitlines()[0])


def _looked_up(tool: str, look: Callable[[], DataFrame], cite: Callable[[dict], dict], hidden: tuple[str, ...] = (), cap: int = CAP) -> Answer:
    """The first cap rows with a citation each; one row more is fetched to know whether the cap cut them. Columns in hidden serve the citations alone."""
    try:
        rows = [r.asDict(recursive=True) for r in look().limit(cap + 1).collect()]
    except Exception as e:
        return Answer(tool, error="query_failed", detail=str(e).splitlines()[0])
    cut = rows[:cap]
    citations = [cite(r) for r in cut]
    data = [{k: v for k, v in r.items() if k not in hidden} for r in cut]
    return Answer(tool, data, citations, len(cut), len(rows) > cap)


def search_bond_terms(tables: dict[str, DataFrame], cap: int = CAP, **asked: str | None) -> Answer:
    """Terms by issuer, document_name, series_code, category_code, tenor (contained) and nature_of_indebtedness, in the order of series and category."""
    order = [F.asc_nulls_first(c) for c in ("series_code", "category_code", "series_id")]
    cite = lambda r: {"source_type": "sql", "source_id": f"series:{r['series_id']}", "document_name": r["document_name"], "page_number": r["first_page"], "section": r["section"]}
    return _looked_up("sql_search_bond_terms", lambda: search.bond_terms(tables, **asked).orderBy(*order), cite, ("first_page", "section"), cap)


def get_issue_overview(tables: dict[str, DataFrame], issuer: str | None = None, document_name: str | None = None, cap: int = CAP) -> Answer:
    """Issue facts with ratings and lead managers, in the order of the issues' ids."""
    cite = lambda r: {"source_type": "sql", "source_id": f"issue:{r['issue_id']}", "document_name": r["document_name"], "section": r["issue_name"]}
    return _looked_up("sql_get_issue_overview", lambda: search.issue_facts(tables, issuer, document_name).orderBy("issue_id"), cite, cap=cap)


#: Columns of a hit.
HIT = ["chunk_id", "chunk_type", "score", "text", "document_name", "issuer", "document_type", "section", "subsection", "section_path", "series_id", "category_id", "start_page", "end_page"]


def vector_search(chunks: DataFrame, query_text: str, embed: vector.Embed, top_k: int = 8, score_threshold: float | None = None, cap: int = CAP, **filters: str | None) -> Answer:
    """The chunks nearest to the text among those that meet the filters (issuer, document_type, chunk_type, series_id, category_id)."""
    cite = lambda r: {"source_type": "vector", "source_id": r["chunk_id"], "document_name": r["document_name"], "page_number": r["start_page"], "section": r["section_path"] or r["section"], "confidence": r["score"]}
    look = lambda: vector.top_k(chunks, embed(query_text), top_k, cap, score_threshold, key="chunk_id", filters=filters).select(*HIT)
    return _looked_up("vector_search", look, cite, cap=cap)


def issuer_neighborhood(edges: DataFrame, issuer: str, depth: int = 2, cap: int = CAP) -> Answer:
    """An issuer's issues with their series, rating agencies, trustees and lead managers. depth is taken and, with these four, has no effect: `neighborhood_to_depth` follows it."""
    cite = lambda r: {"source_type": "graph", "source_id": f"issue:{r['issue_id']}"}
    return _looked_up("graph_query", lambda: graph.issuer_star(edges, issuer).orderBy("issue_id"), cite, cap=cap)


def neighborhood_to_depth(edges: DataFrame, name: str, depth: int, cap: int = CAP) -> Answer:
    """Every vertex within `depth` edges of one, whatever their direction, with its least distance."""
    both = edges.selectExpr("source", "target").union(edges.selectExpr("target AS source", "source AS target"))
    starts = edges.sparkSession.createDataFrame([(name,)], "node string")
    cite = lambda r: {"source_type": "graph", "source_id": f"vertex:{r['node']}"}
    return _looked_up("graph_query", lambda: graph.reached(starts, both, depth).orderBy("depth", "node"), cite, cap=cap)


#: Roles of the participant look-up and the edges that stand for them: fixed values.
ROLES = {"trustee": "HAS_DEBENTURE_TRUSTEE", "lead_manager": "HAS_LEAD_MANAGER", "rating_agency": "RATED_BY"}


def find_issues_by_participant(edges: DataFrame, participant: str, role: str = "any", cap: int = CAP) -> Answer:
    """Issues in which a participant whose name contains the text, whatever the case, has the role; any other role is every role."""
    issued = edges.filter("type = 'ISSUED'").selectExpr("source AS issuer", "target AS issue_id")
    labels = {"HAS_DEBENTURE_TRUSTEE": "DebentureTrustee", "HAS_LEAD_MANAGER": "LeadManager", "RATED_BY": "RatingAgency"}
    legs = {labels[t]: issued.join(edges.filter(F.col("type") == t).selectExpr("source AS issue_id", "target AS participant"), "issue_id") for t in ([ROLES[role]] if role in ROLES else ROLES.values())}
    cite = lambda r: {"source_type": "graph", "source_id": f"issue:{r['issue_id']}"}
    return _looked_up("graph_query", lambda: graph.participants(legs, participant).orderBy("issuer", "issue_id", "participant", "role"), cite, cap=cap)


def health(spark: SparkSession, tables: list[str]) -> dict[str, bool]:
    out = {"sql": spark.range(1).select(F.lit(1)).count() == 1}
    return out | {t: spark.catalog.tableExists(t) for t in tables}
