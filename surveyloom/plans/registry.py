"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL that gives the same rows, if there is one."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = with_views(sql)
        return build

    return register


def r(x: str, digits: int = 4) -> str:
    """The library's rounding rule in SQL."""
    return f"(CASE WHEN abs(({x})*1e{digits}) >= 4503599627370496 THEN ({x})::DOUBLE ELSE floor(({x})*1e{digits}+0.500001)/1e{digits} END)"


_E = "CAST(e.embedding[{}] AS DOUBLE)"
_ITEMS = ", ".join(
    "CASE WHEN e.embedding IS NOT NULL THEN greatest(0, least(10, CAST(floor(5 + 14*"
    + _E.format((i - 1) // 3 + 1)
    + " + 7*"
    + _E.format(10 + i)
    + f") AS INT))) END AS item_{i}"
    for i in range(1, 10)
)
VIEWS = {
    "survey": f"""SELECT d.doc_id AS survey_id, {_ITEMS}, d.text AS text_feedback, d.lang AS language,
  CASE WHEN d.n_chars < 800 THEN 'short' WHEN d.n_chars < 3000 THEN 'medium' ELSE 'long' END AS detail_level,
  CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' WHEN l.quality = 0 THEN 'neutral' END AS sentiment_class
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "pred": """SELECT *, CASE WHEN survey_id % 7 = 0 THEN 'neutral' WHEN survey_id % 11 = 0 THEN 'positive' ELSE sentiment_class END AS y_pred,
  CAST((survey_id * 37) % 1000 AS DOUBLE) / 1000 AS conf FROM survey WHERE sentiment_class IS NOT NULL""",
    "results": """SELECT survey_id AS row_idx, survey_id, item_1, item_2, item_3, item_4, item_5, item_6, item_7, item_8, item_9,
  text_feedback, language, detail_level, sentiment_class, y_pred AS sentiment_pred, conf AS sentiment_conf FROM pred""",
}
_NEEDS = {"survey": ["survey"], "pred": ["survey", "pred"], "results": ["survey", "pred", "results"]}


def with_views(sql: str) -> str:
    """Put the derived views a statement mentions in front of it."""
    import re

    wanted: list[str] = []
    for name, needs in _NEEDS.items():
        if re.search(rf"\b{name}\b", sql):
            wanted += [n for n in needs if n not in wanted]
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH "):
        body = body[len(head) :]
        own = True
    else:
        own = False
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted)
    if not views:
        return head + body if own else body
    return f"{head}{views}, {body}" if own else f"{head}{views} {body}"
