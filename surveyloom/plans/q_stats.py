"""Queries: joins, aggregates, association, psychometrics, contradiction, sampling, windows, set operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from surveyloom.functions import text as T
from surveyloom.functions.intervals import wilson
from surveyloom.functions.numbers import rounded
from surveyloom.operators import align, association, compare, contradiction, evaluate, profile, psychometrics, ranks, resample, sampling
from surveyloom.operators.common import with_scalars
from surveyloom.operators.versions import branch_heads, next_versions, version_history
from surveyloom.plans.q_tables import SQL_SPLIT, not_blank, sql_words
from surveyloom.plans.registry import query, r
from surveyloom.session import settle
from surveyloom.sources.tables import FACTORS, ITEMS, LABELS, predictions, results, survey, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TCRIT = (
    "CASE WHEN {n} - 1 BETWEEN 1 AND 30 THEN [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.16, 2.145, 2.131, 2.12, 2.11,"
    " 2.101, 2.093, 2.086, 2.08, 2.074, 2.069, 2.064, 2.06, 2.056, 2.052, 2.048, 2.045, 2.042][CAST({n} - 1 AS INT)]::DOUBLE ELSE 1.959963984540054::DOUBLE END"
)


def sql_wilson(k: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054::DOUBLE"
    p = f"(({k})::DOUBLE / ({n}))"
    den = f"(1.0 + {z} * {z} / ({n}))"
    mid = f"(({p} + {z} * {z} / (2.0 * ({n}))) / {den})"
    half = f"({z} * sqrt(({p} * (1.0 - {p}) + {z} * {z} / (4.0 * ({n}))) / ({n})) / {den})"
    return r(f"greatest(0.0, {mid} - {half})"), r(f"least(1.0, {mid} + {half})")


def sql_summary(source: str, key: str = '"column"') -> str:
    """Numeric summary of a (key, value) relation with a total row count ``rows`` per key."""
    std = "(CASE WHEN count(num) > 1 THEN stddev_samp(num) ELSE 0 END)"
    half = f"(CASE WHEN count(num) > 1 AND {std} > 0 THEN ({TCRIT.format(n='count(num)')}) * ({std} / sqrt(count(num)::DOUBLE)) ELSE 0 END)"
    return f"""SELECT {key}, count(num) AS count, count(*) - count(num) AS missing, {r("avg(num)")} AS mean, {r(std)} AS std, {r("min(num)")} AS min,
      {r("quantile_cont(num, 0.25)")} AS q25, {r("quantile_cont(num, 0.5)")} AS median, {r("quantile_cont(num, 0.75)")} AS q75, {r("max(num)")} AS max,
      {r(f"avg(num) - {half}")} AS ci_low, {r(f"avg(num) + {half}")} AS ci_high FROM {source} GROUP BY {key}"""


def sql_long(columns: list[str], source: str, cast: str = "DOUBLE", name: str = "num") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS {cast}) AS {name} FROM {source}" for c in columns)


def union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- joins ------------------------------------------------------------------------------------------------------------------

# Fixed loadings that make scoring exact: every item of a factor counts alike.
LOADINGS = np.array([[1.0 if i in items else 0.0 for items in FACTORS.values()] for i in ITEMS])
_Z = {i: f"(({i} - m_{i}) / (s_{i} + 1e-8::DOUBLE))" for i in ITEMS}
SQL_SCORES = (
    "complete AS (SELECT survey_id, "
    + ", ".join(f"{i}::DOUBLE AS {i}" for i in ITEMS)
    + " FROM survey WHERE "
    + " AND ".join(f"{i} IS NOT NULL" for i in ITEMS)
    + "), mom AS (SELECT "
    + ", ".join(f"avg({i}) AS m_{i}, stddev_pop({i}) AS s_{i}" for i in ITEMS)
    + " FROM complete), scores AS (SELECT survey_id, "
    + ", ".join(
        "(" + " + ".join(f"{_Z[i]} * {1 / 3!r}::DOUBLE" for i in items) + f") AS {f}" for f, items in FACTORS.items()
    )
    + " FROM complete, mom)"
)


def fixed_scores(spark, sf):
    return psychometrics.score_with_loadings(survey(spark, sf), "survey_id", ITEMS, list(FACTORS), LOADINGS)


@query(
    "e1_align_scores",
    f"WITH {SQL_SCORES} SELECT survey_id, language, {', '.join(r(f, 6) + f' AS {f}' for f in FACTORS)} FROM survey JOIN scores USING (survey_id)",
)
def _e1(spark, sf):
    frame = survey(spark, sf).select("survey_id", "language")
    joined = align.join_scores(frame, fixed_scores(spark, sf))
    return joined.select("survey_id", "language", *[rounded(F.col(f), 6).alias(f) for f in FACTORS])


def _run(spark, sf, which: int):
    """Three runs over the same rows that differ in their predictions; the third one lacks some rows."""
    frame = results(spark, sf).select("row_idx", "language", "sentiment_pred", "sentiment_conf")
    if which == 0:
        return frame
    shifted = F.when(F.col("row_idx") % (5 + which) == 0, "positive").otherwise(F.col("sentiment_pred"))
    frame = frame.withColumn("sentiment_pred", shifted)
    return frame.where(F.col("row_idx") % 13 != 0) if which == 2 else frame


SQL_RUNS = """run0 AS (SELECT row_idx, language, sentiment_pred FROM results),
  run1 AS (SELECT row_idx, language, CASE WHEN row_idx % 6 = 0 THEN 'positive' ELSE sentiment_pred END AS sentiment_pred FROM results),
  run2 AS (SELECT row_idx, language, CASE WHEN row_idx % 7 = 0 THEN 'positive' ELSE sentiment_pred END AS sentiment_pred FROM results WHERE row_idx % 13 <> 0)"""


@query(
    "e2_align_runs",
    f"WITH {SQL_RUNS} SELECT row_idx, a.sentiment_pred || '|' || b.sentiment_pred || '|' || c.sentiment_pred AS preds FROM run0 a JOIN run1 b USING (row_idx) JOIN run2 c USING (row_idx)",
)
def _e2(spark, sf):
    rows = align.align_runs([_run(spark, sf, i) for i in range(3)], ["sentiment_pred"])
    return rows.select("row_idx", F.array_join("sentiment_pred", "|").alias("preds"))


@query(
    "e3_two_run_join",
    f"WITH {SQL_RUNS} SELECT row_idx, a.sentiment_pred AS pred_1, b.sentiment_pred AS pred_2 FROM run0 a JOIN run1 b USING (row_idx)",
)
def _e3(spark, sf):
    return align.two_runs(_run(spark, sf, 0), _run(spark, sf, 1), "sentiment_pred")


@query(
    "e4_split_overlaps",
    """WITH s AS (SELECT DISTINCT o_custkey AS id, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM orders)
    SELECT a.split AS "left", b.split AS "right", count(*) AS n_shared FROM s a JOIN s b ON a.id = b.id AND a.split < b.split GROUP BY ALL""",
)
def _e4(spark, sf):
    k = F.col("o_orderkey") % 10
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.when(k < 8, "train").when(k == 8, "val").otherwise("test").alias("split")
    )
    return sampling.split_overlaps(rows, "id")


def _cells(spark, sf):
    return survey(spark, sf).select(
        F.col("survey_id").alias("row_idx"), "language", "detail_level", F.coalesce("sentiment_class", F.lit("")).alias("sentiment_class")
    )


@query(
    "e5_cell_edits",
    """WITH ed AS (SELECT event_id AS seq, event_id % 500 AS row_idx, CASE WHEN event_id % 3 = 0 THEN 'language' ELSE 'sentiment_class' END AS col, event_type AS value FROM events),
    last AS (SELECT row_idx, max_by(value, CASE WHEN col = 'language' THEN seq END) AS l, max_by(value, CASE WHEN col = 'sentiment_class' THEN seq END) AS s FROM ed GROUP BY row_idx)
    SELECT survey_id AS row_idx, coalesce(l, language) AS language, detail_level, coalesce(s, coalesce(sentiment_class, '')) AS sentiment_class FROM survey LEFT JOIN last ON last.row_idx = survey_id""",
)
def _e5(spark, sf):
    edits = table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 500).alias("row_idx"),
        F.when(F.col("event_id") % 3 == 0, "language").otherwise("sentiment_class").alias("col"),
        F.col("event_type").alias("value"),
    )
    return align.apply_edits(_cells(spark, sf), edits)


@query(
    "e6_delete_rows",
    """SELECT row_number() OVER (ORDER BY survey_id) - 1 AS row_idx, language, detail_level, coalesce(sentiment_class, '') AS sentiment_class
    FROM survey WHERE survey_id NOT IN (SELECT doc_id FROM labels)""",
)
def _e6(spark, sf):
    return align.delete_rows(_cells(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").alias("row_idx")))


@query(
    "e7_analyses_using_models",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 50 = 0))""",
)
def _e7(spark, sf):
    bridge = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    models = table(spark, sf, "part").where("p_partkey % 50 = 0").select("p_partkey")
    return align.users_of(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), bridge, "o_orderkey", "p_partkey", models)


SQL_VERSIONS = """versions AS (SELECT o_custkey AS dataset, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderkey,
  o_orderstatus <> 'P' AS is_live, o_orderkey % 11 = 0 AS marked FROM orders),
  vh AS (SELECT *, marked AND is_live AND version = max(CASE WHEN marked AND is_live THEN version END) OVER (PARTITION BY dataset) AS is_head FROM versions)"""


def _versions(spark, sf):
    """Commits of a dataset per customer: numbered by date, some hidden, at most one marked as head."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("dataset"),
        "o_orderkey",
        "o_orderdate",
        (F.col("o_orderstatus") != "P").alias("is_live"),
        (F.col("o_orderkey") % 11 == 0).alias("marked"),
    )
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    numbered = next_versions(orders, "dataset", month, [F.col("o_orderdate"), F.col("o_orderkey")])
    head = F.max(F.when(F.col("marked") & F.col("is_live"), F.col("version"))).alias("_head")
    heads = numbered.groupBy("dataset").agg(head)
    is_head = F.coalesce(F.col("marked") & F.col("is_live") & (F.col("version") == F.col("_head")), F.lit(False))
    return numbered.join(heads, "dataset").withColumn("is_head", is_head).drop("_head", "o_orderdate")


@query(
    "e8_current_versions",
    f"""WITH {SQL_VERSIONS}, cur AS (SELECT dataset, version, o_orderkey FROM versions WHERE is_live QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY version DESC) = 1)
    SELECT c_custkey, version, o_orderkey FROM customer LEFT JOIN cur ON dataset = c_custkey""",
)
def _e8(spark, sf):
    from surveyloom.operators.versions import branch_heads

    versions = _versions(spark, sf).withColumn("is_head", F.lit(False))
    current = branch_heads(versions, ["dataset"]).select(F.col("dataset").alias("c_custkey"), "version", "o_orderkey")
    return table(spark, sf, "customer").select("c_custkey").join(current, "c_custkey", "left")


@query(
    "e9_lookup_join",
    f"""WITH m AS (SELECT l_returnflag, {r("avg(l_discount)", 6)} AS typical FROM lineitem GROUP BY 1)
    SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_discount > typical) AS above FROM lineitem JOIN m USING (l_returnflag) GROUP BY ALL""",
)
def _e9(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_discount")
    typical = rows.groupBy("l_returnflag").agg(rounded(F.avg("l_discount"), 6).alias("typical"))
    return (
        rows.join(F.broadcast(typical), "l_returnflag")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > F.col("typical")).alias("above"))
    )


# --- aggregates ----------------------------------------------------------------------------------------------------------------


@query("f1_numeric_summary", f"WITH long AS ({sql_long(LINE, 'lineitem')} UNION ALL {sql_long(['item_1', 'item_5'], 'survey')}) {sql_summary('long')}")
def _f1(spark, sf):
    return profile.numeric_summary(table(spark, sf, "lineitem"), LINE).unionByName(
        profile.numeric_summary(survey(spark, sf), ["item_1", "item_5"])
    )


_CAT = [*LABELS, "text_feedback"]


def sql_frequency(columns: list[str], source: str, top: int = 25) -> str:
    low, high = sql_wilson("n", "count")
    return f"""WITH long AS ({sql_long(columns, source, 'VARCHAR', 'value')}),
    lv AS (SELECT "column", CASE WHEN {not_blank("value")} THEN value END AS level, count(*) AS n FROM long GROUP BY ALL),
    tot AS (SELECT "column", CAST(coalesce(sum(n) FILTER (WHERE level IS NOT NULL), 0) AS BIGINT) AS count, CAST(coalesce(sum(n) FILTER (WHERE level IS NULL), 0) AS BIGINT) AS missing, count(level) AS n_unique FROM lv GROUP BY 1),
    rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS rank FROM lv WHERE level IS NOT NULL),
    fr AS (SELECT "column", count, missing, n_unique, rank, level, n AS level_count, {r("n::DOUBLE / count")} AS proportion, {low} AS ci_low, {high} AS ci_high
    FROM rk JOIN tot USING ("column") WHERE rank <= {top})"""


@query("f2_categorical_frequency", sql_frequency(_CAT, "survey") + " SELECT * FROM fr")
def _f2(spark, sf):
    return profile.categorical_frequency(survey(spark, sf), _CAT)


SQL_TEXT_CELLS = f"""tl AS (SELECT "column", value FROM ({{long}}) WHERE {not_blank("value").replace("{", "{{").replace("}", "}}")}),
  cells AS (SELECT "column", 'char_length' AS measure, length(value)::DOUBLE AS num FROM tl UNION ALL
  SELECT "column", 'word_length', {sql_words("value").replace("{", "{{").replace("}", "}}")}::DOUBLE FROM tl)"""


@query(
    "f3_text_length_stats",
    "WITH " + SQL_TEXT_CELLS.format(long=sql_long(["text_feedback", "language"], "survey", "VARCHAR", "value")) + sql_summary("cells", '"column", measure'),
)
def _f3(spark, sf):
    return profile.text_length_stats(survey(spark, sf), ["text_feedback", "language"])


_METRICS = profile.SUMMARY_METRICS


def sql_metrics(source: str, section: str, name: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, \"column\", {name} AS name, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}" for m in metrics
    )


def sql_descriptive(numeric: list[str], other: list[str], source: str) -> str:
    return (
        sql_frequency(other, source)
        + f", nlong AS ({sql_long(numeric, source)}), ns AS ({sql_summary('nlong')}), "
        + SQL_TEXT_CELLS.format(long=sql_long(other, source, "VARCHAR", "value"))
        + f", ts AS ({sql_summary('cells', chr(34) + 'column' + chr(34) + ', measure')}) "
        + sql_metrics("ns", "numeric", "''", _METRICS)
        + " UNION ALL "
        + sql_metrics("fr", "categorical", "level", ["count", "missing", "n_unique", "level_count", "proportion", "ci_low", "ci_high"])
        + " UNION ALL "
        + sql_metrics("ts", "text", "measure", _METRICS)
    )


_DESCRIBED = ["item_1", "item_4", "item_9", "text_feedback", *LABELS]


@query("f4_descriptive_summary", sql_descriptive(["item_1", "item_4", "item_9"], ["text_feedback", *LABELS], "survey"))
def _f4(spark, sf):
    return profile.descriptive_summary(survey(spark, sf), _DESCRIBED)


_LOW, _HIGH = sql_wilson("k", "n")


@query(
    "f5_wilson_interval",
    f"WITH g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem GROUP BY 1) SELECT l_suppkey, n, k, {_LOW} AS low, {_HIGH} AS high FROM g",
)
def _f5(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k")
    )
    low, high = wilson(F.col("k"), F.col("n"))
    return g.select("l_suppkey", "n", "k", low.alias("low"), high.alias("high"))


@query(
    "f6_mean_interval",
    f"""WITH long AS ({sql_long(LINE, 'lineitem')}), s AS ({sql_summary('long')}) SELECT "column", count AS n, mean AS estimate, ci_low AS low, ci_high AS high FROM s""",
)
def _f6(spark, sf):
    return profile.mean_interval(table(spark, sf, "lineitem"), LINE)


def _bracketed(found, digits=4):
    """What the data determine of a bootstrap: the estimate, and that it lies within the interval."""
    inside = (F.col("low") < F.col("estimate")) & (F.col("estimate") < F.col("high"))
    return found.select("n", rounded(F.col("estimate"), digits).alias("estimate"), inside.alias("inside"), "n_resamples")


@query("f7_bootstrap_interval", f"SELECT count(l_quantity) AS n, {r('avg(l_quantity)')} AS estimate, true AS inside, 500 AS n_resamples FROM lineitem")
def _f7(spark, sf):
    return _bracketed(profile.bootstrap_interval(table(spark, sf, "lineitem"), F.col("l_quantity"), n_resamples=500))


@query("p2_bootstrap_custom_metric", f"SELECT count(value) AS n, {r('quantile_cont(value, 0.5)')} AS estimate, true AS inside, 200 AS n_resamples FROM events")
def _p2(spark, sf):
    return _bracketed(profile.bootstrap_interval(table(spark, sf, "events"), F.col("value"), 0.5, n_resamples=200))


class TrimmedMean:
    """A metric of the user's own: the mean of the values between two bounds."""

    def __init__(self, low: float, high: float):
        self.low, self.high = low, high

    def init(self, n):
        return np.zeros((2, n))

    def update(self, state, values, weights):
        inside = ((values >= self.low) & (values <= self.high)).astype(float)
        return state + np.stack([inside @ weights, (values * inside) @ weights])

    def merge(self, left, right):
        return left + right

    def finish(self, state):
        return np.where(state[0] > 0, state[1] / np.maximum(state[0], 1), np.nan)


def sql_draws(source: str, unit: str, value: str, n: int, seed: int = 42) -> str:
    """Relation ``w`` (r, v, w) of the portable bootstrap weights; replicate 0 is the data itself."""
    weight = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in resample.POISSON_ONE)
    return f"""WITH u AS (SELECT {value} AS v, r, ('0x' || substr(md5('{seed}:' || {unit} || ':' || r), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u
      FROM {source}, (SELECT unnest(range(1, {n + 1})) AS r) WHERE {value} IS NOT NULL AND NOT isnan({value})),
    w AS (SELECT r, v, {weight} AS w FROM u UNION ALL SELECT 0, {value}, 1 FROM {source} WHERE {value} IS NOT NULL AND NOT isnan({value}))"""


def sql_interval(n: int, digits: int = 4) -> str:
    """The result row from a relation ``d`` (r, m) of the metric per replicate and the weights ``w``."""
    bound = "(SELECT quantile_cont(m, {}) FROM d WHERE r > 0)"
    cells = {"estimate": "(SELECT m FROM d WHERE r = 0)", "low": bound.format(0.025), "high": bound.format(0.975)}
    shown = ", ".join(f"{r(c, digits)} AS {k}" for k, c in cells.items())
    return f"SELECT (SELECT count(*) FROM w WHERE r = 0) AS n, {shown}, (SELECT count(*) FROM d WHERE r > 0) AS n_resamples"


@query(
    "p2_user_metric",
    f"""{sql_draws("events", "event_id", "value", 60)}, d AS (SELECT r, sum(v * w) / sum(w) AS m FROM w WHERE v BETWEEN 2 AND 20 AND w > 0 GROUP BY r) {sql_interval(60)}""",
)
def _p2b(spark, sf):
    return resample.bootstrap_metric(table(spark, sf, "events"), F.col("value"), TrimmedMean(2.0, 20.0), 60, unit=F.col("event_id"))


@query(
    "j4_quantile_draws",
    f"""{sql_draws("events", "event_id", "value", 40)}, c AS (SELECT r, v, sum(w) AS w FROM w WHERE w > 0 GROUP BY r, v),
    e AS (SELECT r, v, sum(w) OVER (PARTITION BY r ORDER BY v) AS e, w, 0.9::DOUBLE * (sum(w) OVER (PARTITION BY r) - 1) AS p FROM c),
    x AS (SELECT r, any_value(p) AS p, max(v) FILTER (WHERE floor(p) >= e - w AND floor(p) < e) AS lo, max(v) FILTER (WHERE ceil(p) >= e - w AND ceil(p) < e) AS hi FROM e GROUP BY r),
    d AS (SELECT r, lo + (hi - lo) * (p - floor(p)) AS m FROM x) {sql_interval(40)}""",
)
def _j4b(spark, sf):
    return resample.bootstrap_metric(table(spark, sf, "events"), F.col("value"), 0.9, 40, unit=F.col("event_id"))


@query(
    "f7_mean_draws",
    f"""{sql_draws("events", "event_id", "value", 60)}, d AS (SELECT r, sum(v * w) / sum(w) AS m FROM w GROUP BY r) {sql_interval(60)}""",
)
def _f7b(spark, sf):
    return resample.bootstrap_metric(table(spark, sf, "events"), F.col("value"), resample.Moments("mean"), 60, unit=F.col("event_id"))


@query(
    "f8_distributions",
    """SELECT 'language' AS "column", language AS value, count(*) AS count FROM results GROUP BY 2 UNION ALL SELECT 'sentiment_pred', sentiment_pred, count(*) FROM results GROUP BY 2
    UNION ALL SELECT 'item_1', coalesce(CAST(item_1 AS VARCHAR), ''), count(*) FROM results GROUP BY 2""",
)
def _f8(spark, sf):
    return profile.distributions(results(spark, sf), ["language", "sentiment_pred", "item_1", "nowhere"])


def sql_segments(group: str, metric: str, source: str) -> str:
    return f"""SELECT {group} AS "group", count(*) AS count, {r(f"avg({metric})")} AS mean, {r(f"quantile_cont({metric}, 0.5)")} AS median,
      {r(f"CASE WHEN count(*) > 1 THEN stddev_samp({metric}) ELSE 0 END")} AS std FROM {source} WHERE {metric} IS NOT NULL GROUP BY 1"""


@query("f9_segment_stats", sql_segments("language", "sentiment_conf", "results"))
def _f9(spark, sf):
    return profile.segment_stats(results(spark, sf), "language", "sentiment_conf")


@query("f9_segment_stats_lineitem", sql_segments("l_shipdate::DATE::VARCHAR", "l_extendedprice", "lineitem"))
def _f9b(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("day"), "l_extendedprice")
    return profile.segment_stats(rows, "day", "l_extendedprice", few_groups=False)


@query("f10_class_distribution", f"SELECT sentiment_pred AS label, count(*) AS n, {r('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS share FROM results GROUP BY 1")
def _f10(spark, sf):
    return profile.shares(results(spark, sf), "sentiment_pred")


@query(
    "f11_confusion_matrix",
    """WITH l AS (SELECT sentiment_class AS c FROM pred UNION SELECT y_pred FROM pred), k AS (SELECT sentiment_class, y_pred, count(*) AS n FROM pred GROUP BY ALL)
    SELECT a.c AS y_true, b.c AS y_pred, coalesce(n, 0) AS n FROM l a, l b LEFT JOIN k ON k.sentiment_class = a.c AND k.y_pred = b.c""",
)
def _f11(spark, sf):
    return evaluate.confusion_matrix(predictions(spark, sf), "sentiment_class", "y_pred")


def sql_classification(source: str, y: str, p: str, by: str = "", digits: int = 6, min_rows: int = 0) -> str:
    b = f"{by}, " if by else ""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    on = " AND ".join(f"l.{c.strip()} = t.{c.strip()}" for c in by.split(",")) if by else "TRUE"
    return f"""lab AS (SELECT {b}label, CAST(sum(t) AS BIGINT) AS support, sum(s) AS said, sum(h) AS tp FROM (SELECT {b}{y} AS label, 1 AS t, 0 AS s, CASE WHEN {y} = {p} THEN 1 ELSE 0 END AS h FROM {source}
      UNION ALL SELECT {b}{p}, 0, 1, 0 FROM {source}) GROUP BY ALL),
    met AS (SELECT *, CASE WHEN said > 0 THEN tp::DOUBLE / said ELSE 0 END AS p, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS rc,
      CASE WHEN said + support > 0 THEN 2 * tp::DOUBLE / (said + support) ELSE 0 END AS f FROM lab),
    tot AS (SELECT {b}count(*) AS n_samples, count(*) FILTER (WHERE {y} = {p})::DOUBLE / count(*) AS acc FROM {source} {"GROUP BY " + by if by else ""}),
    cls AS (SELECT {", ".join("l." + c.strip() for c in by.split(",")) + ", " if by else ""}label, support, {r("p", digits)} AS precision, {r("rc", digits)} AS recall, {r("f", digits)} AS f1,
      {r("acc", digits)} AS accuracy, {r("mf", digits)} AS macro_f1, n_samples FROM (SELECT *, avg(f) {over} AS mf FROM met) l JOIN tot t ON {on} WHERE n_samples >= {min_rows})"""


@query("f12_classification_metrics", f"WITH {sql_classification('pred', 'sentiment_class', 'y_pred')} SELECT * FROM cls")
def _f12(spark, sf):
    return evaluate.classification_metrics(predictions(spark, sf), "sentiment_class", "y_pred")


@query("f13_metrics_by_stratum", f"WITH {sql_classification('pred', 'sentiment_class', 'y_pred', 'language', min_rows=2)} SELECT * FROM cls")
def _f13(spark, sf):
    return evaluate.classification_metrics(predictions(spark, sf), "sentiment_class", "y_pred", ["language"], min_rows=2)


@query("f14_diagnostics", f"WITH dg AS (SELECT * FROM pred WHERE y_pred <> ''), {sql_classification('dg', 'sentiment_class', 'y_pred', digits=4)} SELECT * FROM cls")
def _f14(spark, sf):
    return evaluate.classification_diagnostics(predictions(spark, sf), "sentiment_class", "y_pred")


def sql_calibration(source: str, y: str, p: str, c: str) -> str:
    return f"""cb AS (SELECT greatest(1, CAST(ceil(greatest(0.0, least(1.0, {c})) * 10) AS INT)) AS bin, greatest(0.0, least(1.0, {c})) AS c, CASE WHEN {y} = {p} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h FROM {source} WHERE {c} IS NOT NULL),
    cg AS (SELECT bin, count(*) AS count, avg(c) AS mc, avg(h) AS ma FROM cb GROUP BY bin),
    cal AS (SELECT bin, (bin - 1) / 10.0::DOUBLE AS low, bin / 10.0::DOUBLE AS high, count, {r("mc")} AS avg_confidence, {r("ma")} AS accuracy,
      {r("sum(count * abs(ma - mc)) OVER () / sum(count) OVER ()")} AS ece FROM cg)"""


@query("f15_calibration", f"WITH {sql_calibration('pred', 'sentiment_class', 'y_pred', 'conf')} SELECT * FROM cal")
def _f15(spark, sf):
    return evaluate.calibration_bins(predictions(spark, sf), "sentiment_class", "y_pred", "conf")


# Regression pairs on lineitem: price against a fixed multiple of quantity, discount against tax.
_FIT = {"price": ("l_extendedprice", "price_hat"), "discount": ("l_discount", "l_tax")}
SQL_FIT = "fit AS (SELECT *, l_quantity * 1500.0::DOUBLE + 100.0 * l_tax AS price_hat FROM lineitem)"


def _fit(spark, sf):
    return table(spark, sf, "lineitem").withColumn("price_hat", F.col("l_quantity") * 1500.0 + 100.0 * F.col("l_tax"))


def sql_regression(by: str = "") -> str:
    b = f"{by}, " if by else ""
    parts = " UNION ALL ".join(
        f"SELECT {b}'{t}' AS target, count(*) AS n, avg(abs({y} - {p})) AS m, 1.0 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*)) AS q FROM fit {'GROUP BY ' + by if by else ''}"
        for t, (y, p) in _FIT.items()
    )
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return f"WITH {SQL_FIT}, s AS ({parts}) SELECT {b}target, n, {r('m', 4)} AS mae, {r('q', 6)} AS r2, {r(f'avg(m) {over}', 4)} AS mae_overall, {r(f'avg(q) {over}', 6)} AS r2_overall FROM s"


def _round_mae(df):
    return df.withColumns({c: rounded(F.col(c), 4) for c in ("mae", "mae_overall")})


@query("f16_regression_metrics", sql_regression())
def _f16(spark, sf):
    return _round_mae(evaluate.regression_metrics(_fit(spark, sf), _FIT, digits=6))


@query("f17_regression_by_stratum", sql_regression("l_returnflag"))
def _f17(spark, sf):
    return _round_mae(evaluate.regression_metrics(_fit(spark, sf), _FIT, ["l_returnflag"], min_rows=2))


@query(
    "f18_residual_summary",
    f"""WITH {SQL_FIT}, e AS (SELECT price_hat AS f, l_extendedprice - price_hat AS d FROM fit) SELECT count(*) AS n_rows, {r("avg(d)", 3)} AS mean, {r("stddev_samp(d)", 3)} AS std, {r("avg(abs(d))", 3)} AS mae,
    {r("sqrt(avg(d * d))", 3)} AS rmse, {r("min(d)", 3)} AS min, {r("max(d)", 3)} AS max, {r("corr(f, abs(d))")} AS abs_residual_fitted_correlation, {r("quantile_cont(d, 0.5)", 3)} AS median FROM e""",
)
def _f18(spark, sf):
    out = evaluate.residual_summary(_fit(spark, sf), "l_extendedprice", "price_hat")
    return out.withColumns({c: rounded(F.col(c), 3) for c in ("mean", "std", "mae", "rmse", "min", "max", "median")})


@query(
    "f19_residual_bins",
    f"""WITH {SQL_FIT}, e AS (SELECT price_hat AS f, l_extendedprice - price_hat AS d FROM fit),
    q AS (SELECT list_distinct(list_transform(range(0, 11), lambda i: i)) AS ids, list_sort(list_distinct(quantile_cont(f, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM e),
    b AS (SELECT f, d, edges, 1 + len(list_filter(edges[2:len(edges) - 1], lambda x: x < f)) AS bin FROM e, q)
    SELECT bin, {r("min(edges[bin])", 2)} AS low, {r("min(edges[bin + 1])", 2)} AS high, count(*) AS count, {r("avg(f)", 2)} AS mean_fitted, {r("avg(d)", 2)} AS mean_residual, {r("coalesce(stddev_samp(d), 0)", 2)} AS std_residual FROM b GROUP BY bin""",
)
def _f19(spark, sf):
    out = evaluate.residual_bins(_fit(spark, sf), "l_extendedprice", "price_hat")
    names = ("low", "high", "mean_fitted", "mean_residual", "std_residual")
    return out.withColumns({c: rounded(F.col(c), 2) for c in names}).withColumn("bin", F.col("bin").cast("bigint"))


@query(
    "f20_class_inflation",
    f"SELECT count(*) AS n, {r('avg(CASE WHEN sentiment_pred = ' + chr(39) + 'neutral' + chr(39) + ' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS rate, avg(CASE WHEN sentiment_pred = 'neutral' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.6 AS inflated FROM results",
)
def _f20(spark, sf):
    return profile.class_inflation(results(spark, sf), "sentiment_pred")


@query(
    "f21_training_profile",
    f"""WITH x AS (SELECT 'text_length_chars' AS section, length(text_feedback)::DOUBLE AS num FROM survey UNION ALL SELECT 'text_length_words', {sql_words("text_feedback")}::DOUBLE FROM survey)
    SELECT section, p.name, {r("quantile_cont(num, p.q)", 2)} AS value FROM x, (VALUES ('p05', 0.05), ('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('p95', 0.95)) p(name, q) GROUP BY section, p.name, p.q
    UNION ALL SELECT 'class_priors', coalesce(sentiment_class, ''), {r("count(*)::DOUBLE / sum(count(*)) OVER ()")} FROM survey GROUP BY 2
    UNION ALL SELECT 'vocabulary_size', '', count(DISTINCT w)::DOUBLE FROM (SELECT unnest(regexp_extract_all(lower(text_feedback), '[^{T.BLANK}]+')) AS w FROM survey)""".replace(
        "quantile_cont(num, p.q)",
        "CASE p.name WHEN 'p05' THEN quantile_cont(num, 0.05) WHEN 'p25' THEN quantile_cont(num, 0.25) WHEN 'p50' THEN quantile_cont(num, 0.5) WHEN 'p75' THEN quantile_cont(num, 0.75) ELSE quantile_cont(num, 0.95) END",
    ),
)
def _f21(spark, sf):
    from surveyloom.functions.ngrams import blank_separated

    frame = survey(spark, sf)
    words = frame.select(F.explode(blank_separated(F.col("text_feedback"))).alias("term")).distinct()
    return profile.training_profile(frame, "text_feedback", "sentiment_class", words)


@query(
    "f22_split_distribution",
    f"WITH {SQL_SPLIT.format(s='sentiment_class', t='survey', k='survey_id')} SELECT split, sentiment_class, count(*) AS n, {r('count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split)', 6)} AS share FROM split GROUP BY split, sentiment_class",
)
def _f22(spark, sf):
    from pyspark.sql import Window

    parts = sampling.stratified_split(survey(spark, sf).select("survey_id", "sentiment_class"))
    counts = parts.groupBy("split", "sentiment_class").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("split")), 6))


SQL_FLAGS = (
    SQL_SCORES
    + ", th AS (SELECT "
    + ", ".join(f"quantile_cont({f}, 0.9) AS h_{f}, quantile_cont({f}, 0.1) AS l_{f}" for f in FACTORS)
    + " FROM scores), fl0 AS (SELECT survey_id, language, detail_level, coalesce(sentiment_class, '') = 'negative' AND ("
    + " OR ".join(f"{f} >= h_{f}" for f in FACTORS)
    + ") AS a, coalesce(sentiment_class, '') = 'positive' AND ("
    + " OR ".join(f"{f} <= l_{f}" for f in FACTORS)
    + ") AS b FROM survey JOIN scores USING (survey_id), th), flags AS (SELECT survey_id, language, detail_level, a AS contradiction_type_a, b AS contradiction_type_b, a OR b AS is_contradiction FROM fl0)"
)
SQL_RATES = (
    """SELECT 'overall' AS dimension, '' AS level, is_contradiction AS hit FROM flags UNION ALL SELECT 'type', 'a', contradiction_type_a FROM flags UNION ALL SELECT 'type', 'b', contradiction_type_b FROM flags
    UNION ALL SELECT 'language', language, is_contradiction FROM flags UNION ALL SELECT 'detail_level', detail_level, is_contradiction FROM flags"""
)


def _flags(spark, sf):
    frame = survey(spark, sf).select("survey_id", *LABELS)
    return contradiction.monitor(frame, settle(fixed_scores(spark, sf), "scores"), list(FACTORS))


@query(
    "f23_contradiction_rates",
    f"WITH {SQL_FLAGS} SELECT dimension, level, count(*) AS n, count(*) FILTER (WHERE hit) AS n_flagged, {r('avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 6)} AS rate FROM ({SQL_RATES}) GROUP BY ALL",
)
def _f23(spark, sf):
    return _flags(spark, sf)[1]


@query(
    "f24_quartile_histogram",
    f"""WITH long AS ({sql_long(LINE, 'lineitem')}), s AS ({sql_summary('long')}), m AS (SELECT "column", count AS n, [min, q25, median, q75, max] AS e FROM s)
    SELECT "column", CAST(i AS INT) AS bin, e[i] AS start, e[i + 1] AS "end", CAST(CASE WHEN i < 4 THEN floor(n * 0.25::DOUBLE + 0.5) ELSE n - floor(n * 0.75::DOUBLE + 0.5) END AS BIGINT) AS bin_count
    FROM m, (SELECT unnest([1, 2, 3, 4]) AS i)""",
)
def _f24(spark, sf):
    return profile.quartile_histogram(profile.numeric_summary(table(spark, sf, "lineitem"), LINE))


@query(
    "f25_platform_rollup",
    """SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total_datasets, (SELECT count(*) FROM part) AS total_models, (SELECT count(*) FROM orders) AS total_analyses,
    (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))) AS total_responses, CAST(9 AS BIGINT) AS n_survey_items""",
)
def _f25(spark, sf):
    datasets = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    columns = spark.createDataFrame([(c,) for c in survey(spark, sf).columns], "name string")
    orders = table(spark, sf, "orders")
    counts = [
        datasets.agg(F.count(F.lit(1)).alias("total_datasets")),
        table(spark, sf, "part").agg(F.count(F.lit(1)).alias("total_models")),
        orders.agg(F.count(F.lit(1)).alias("total_analyses")),
        orders.join(datasets, "o_custkey", "left_semi").agg(F.count(F.lit(1)).alias("total_responses")),
        columns.where(F.col("name").rlike(r"^item_\d+$")).agg(F.count_distinct("name").alias("n_survey_items")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = with_scalars(out, c)
    return out


@query(
    "f26_owner_counts",
    "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def _f26(spark, sf):
    return profile.owner_counts(table(spark, sf, "customer"), table(spark, sf, "orders"), "c_custkey", "o_custkey")


@query("f27_cluster_sizes", "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def _f27(spark, sf):
    from surveyloom.operators.embedding import cluster_sizes

    return cluster_sizes(table(spark, sf, "embeddings").withColumnRenamed("label", "cluster"))


def _share(run: str) -> str:
    return f"(SELECT sentiment_pred AS label, {r('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS s FROM {run} GROUP BY 1)"


@query(
    "f28_distribution_deltas",
    f"""WITH {SQL_RUNS}, j AS (SELECT coalesce(a.label, b.label) AS label, coalesce(a.s, 0) AS share_1, coalesce(b.s, 0) AS share_2 FROM {_share("run0")} a FULL JOIN {_share("run2")} b ON a.label = b.label)
    SELECT *, {r("share_2 - share_1")} AS delta FROM j""",
)
def _f28(spark, sf):
    return compare.distribution_deltas(_run(spark, sf, 0), _run(spark, sf, 2), "sentiment_pred")


@query(
    "f29_disagreement",
    f"""WITH {SQL_RUNS}, t AS (SELECT 'sentiment' AS task, {r("avg(CASE WHEN a.sentiment_pred <> b.sentiment_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS rate FROM run0 a JOIN run2 b USING (row_idx)
    UNION ALL SELECT 'language', {r("avg(CASE WHEN a.language <> b.language THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} FROM run0 a JOIN run2 b USING (row_idx))
    SELECT * FROM t UNION ALL SELECT 'overall', {r("avg(rate)")} FROM t""",
)
def _f29(spark, sf):
    return compare.disagreement(_run(spark, sf, 0), _run(spark, sf, 2), {"sentiment": "sentiment_pred", "language": "language"})


@query(
    "f30_run_disagreement",
    f"""WITH {SQL_RUNS}, j AS (SELECT a.sentiment_pred = b.sentiment_pred AND b.sentiment_pred = c.sentiment_pred AS same FROM run0 a JOIN run1 b USING (row_idx) JOIN run2 c USING (row_idx))
    SELECT 'sentiment_pred' AS "column", {r("avg(CASE WHEN same THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)")} AS rate FROM j UNION ALL SELECT 'language', 0.0::DOUBLE""",
)
def _f30(spark, sf):
    return align.disagreement_rates([_run(spark, sf, i) for i in range(3)], ["sentiment_pred", "language", "nowhere"])


@query(
    "f31_catalog_totals",
    "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY 1",
)
def _f31(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large")
    )


@query(
    "f32_run_status",
    """WITH s AS (SELECT user_id * 100 + event_id % 100 AS run, CASE WHEN value > 250 THEN 'failed' WHEN value > 40 AND event_type = 'view' THEN 'running' WHEN value > 60 THEN 'pending' ELSE 'completed' END AS st FROM events)
    SELECT run, CASE WHEN bool_or(st = 'failed') THEN 'failed' WHEN bool_and(st = 'completed') THEN 'completed' WHEN bool_or(st = 'running') THEN 'running' ELSE 'pending' END AS status FROM s GROUP BY run""",
)
def _f32(spark, sf):
    status = (
        F.when(F.col("value") > 250, "failed")
        .when((F.col("value") > 40) & (F.col("event_type") == "view"), "running")
        .when(F.col("value") > 60, "pending")
        .otherwise("completed")
    )
    stages = table(spark, sf, "events").select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("run"), status.alias("st"))
    return profile.run_status(stages, "run", "st")


# --- association ------------------------------------------------------------------------------------------------------------------

_PAIRS = [("item_1", "item_2"), ("item_1", "item_4"), ("item_7", "item_9")]
_LPAIRS = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"), ("l_extendedprice", "l_discount")]


def sql_pearson(a: str, b: str, source: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", 'pearson' AS metric, {r(f'coalesce(corr({a}, {b}), 0)')} AS value, count(*) AS n FROM {source} WHERE {both}"


@query(
    "g1_pearson",
    " UNION ALL ".join([sql_pearson(a, b, "survey") for a, b in _PAIRS] + [sql_pearson(a, b, "lineitem") for a, b in _LPAIRS]),
)
def _g1(spark, sf):
    return association.pearson(survey(spark, sf), _PAIRS).unionByName(association.pearson(table(spark, sf, "lineitem"), _LPAIRS))


@query(
    "g1_pearson_matrix",
    " UNION ALL ".join(sql_pearson(ITEMS[a], ITEMS[b], "survey") for a in range(9) for b in range(a + 1, 9)),
)
def _g1_matrix(spark, sf):
    return association.pearson_matrix(survey(spark, sf), ITEMS)


def sql_spearman(a: str, b: str, source: str) -> str:
    rows = f"(SELECT {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    rank = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)"
    return f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", 'spearman' AS metric, {r('coalesce(corr(rx, ry), 0)')} AS value, count(*) AS n FROM (SELECT {rank('x')} AS rx, {rank('y')} AS ry FROM {rows})"


@query("g2_spearman", " UNION ALL ".join([sql_spearman(a, b, "survey") for a, b in _PAIRS] + [sql_spearman(a, b, "lineitem") for a, b in _LPAIRS]))
def _g2(spark, sf):
    return association.spearman(survey(spark, sf), _PAIRS).unionByName(association.spearman(table(spark, sf, "lineitem"), _LPAIRS))


def sql_cramers(a: str, b: str, source: str) -> str:
    where = f"{not_blank(f'CAST({a} AS VARCHAR)')} AND {not_blank(f'CAST({b} AS VARCHAR)')}"
    counts = f"(SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL)"
    sums = f"""(SELECT sum(n::DOUBLE * n / (ra::DOUBLE * cb)) AS ratio, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS k FROM
      (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb FROM {counts}))"""
    phi = "greatest(0.0, greatest(0.0, ratio - 1.0) - (k - 1) * (r - 1) / greatest(n - 1, 1)::DOUBLE)"
    room = "(least(k - (k - 1) * (k - 1) / greatest(n - 1, 1)::DOUBLE, r - (r - 1) * (r - 1) / greatest(n - 1, 1)::DOUBLE) - 1.0)"
    return f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", 'cramers_v' AS metric, {r(f'CASE WHEN {room} > 0 THEN sqrt({phi} / {room}) ELSE 0 END')} AS value, n FROM {sums}"


_CPAIRS = [("language", "detail_level"), ("language", "sentiment_class"), ("detail_level", "sentiment_class")]


@query("g3_cramers_v", " UNION ALL ".join([sql_cramers(a, b, "survey") for a, b in _CPAIRS] + [sql_cramers("l_returnflag", "l_linestatus", "lineitem")]))
def _g3(spark, sf):
    return association.cramers_v(survey(spark, sf), _CPAIRS).unionByName(
        association.cramers_v(table(spark, sf, "lineitem"), [("l_returnflag", "l_linestatus")])
    )


def sql_biserial(a: str, b: str, row: str, source: str) -> str:
    rows = f"(SELECT CAST({a} AS VARCHAR) AS a, {b}::DOUBLE AS y, {row} AS i FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"""SELECT '{a}' AS "left", '{b}' AS "right", 'point_biserial' AS metric, {r("CASE WHEN max(levels) = 2 THEN coalesce(corr(CASE WHEN a = zero THEN 0 ELSE 1 END, y), 0) ELSE 0 END")} AS value, count(*) AS n
      FROM {rows}, (SELECT arg_min(a, i) AS zero, count(DISTINCT a) AS levels FROM {rows})"""


_LINE_IDX = "l_orderkey * 10 + l_linenumber"


def _numbered_lines(spark, sf):
    return table(spark, sf, "lineitem").withColumn("row_idx", F.expr(_LINE_IDX))


@query(
    "g4_point_biserial",
    sql_biserial("l_linestatus", "l_extendedprice", _LINE_IDX, "lineitem")
    + " UNION ALL "
    + sql_biserial("l_returnflag", "l_quantity", _LINE_IDX, "lineitem"),
)
def _g4(spark, sf):
    return association.point_biserial(
        _numbered_lines(spark, sf), [("l_linestatus", "l_extendedprice"), ("l_returnflag", "l_quantity")], "row_idx"
    )


_KIND_COLUMNS = ["item_1", "language", "detail_level", "sentiment_class", "is_english", "step", "nothing", "conf"]


def _kinds_frame(spark, sf):
    return predictions(spark, sf).withColumns(
        {
            "is_english": (F.col("language") == "en").cast("string"),
            "step": F.col("survey_id") % 5,
            "nothing": F.lit(" "),
        }
    )


SQL_KINDS = "kf AS (SELECT *, CAST(language = 'en' AS VARCHAR) AS is_english, survey_id % 5 AS step, ' ' AS nothing FROM pred)"


def _kind(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return f"""SELECT '{c}' AS "column", CASE WHEN u = 0 THEN 'empty' WHEN u = 2 THEN 'binary' WHEN bad = 0 AND u BETWEEN 3 AND 7 THEN 'ordinal' WHEN bad = 0 THEN 'numeric' ELSE 'categorical' END AS kind, u AS n_unique FROM
      (SELECT bad, CASE WHEN bad = 0 THEN nu ELSE tu END AS u FROM (SELECT count(*) FILTER (WHERE {not_blank(v)} AND TRY_CAST({v} AS DOUBLE) IS NULL) AS bad,
      count(DISTINCT TRY_CAST({v} AS DOUBLE)) FILTER (WHERE {not_blank(v)}) AS nu, count(DISTINCT {v}) FILTER (WHERE {not_blank(v)}) AS tu FROM kf))"""


@query("g5_value_kinds", f"WITH {SQL_KINDS} " + " UNION ALL ".join(_kind(c) for c in _KIND_COLUMNS))
def _g5(spark, sf):
    return association.value_kinds(_kinds_frame(spark, sf), _KIND_COLUMNS)


_MIXED = ["item_1", "item_2", "language", "is_english", "step", "conf"]
SQL_MIXED = f"""WITH {SQL_KINDS}, mix AS ({sql_pearson("item_1", "item_2", "kf")} UNION ALL {sql_pearson("item_1", "conf", "kf")} UNION ALL {sql_pearson("item_2", "conf", "kf")}
    UNION ALL {sql_spearman("item_1", "step", "kf")} UNION ALL {sql_spearman("item_2", "step", "kf")} UNION ALL {sql_spearman("step", "conf", "kf")}
    UNION ALL {sql_cramers("language", "is_english", "kf")}
    UNION ALL SELECT "right", "left", metric, value, n FROM ({sql_biserial("is_english", "item_1", "survey_id", "kf")})
    UNION ALL SELECT "right", "left", metric, value, n FROM ({sql_biserial("is_english", "item_2", "survey_id", "kf")})
    UNION ALL {sql_biserial("is_english", "conf", "survey_id", "kf")})"""


@query("g6_mixed_association", SQL_MIXED + " SELECT * FROM mix")
def _g6(spark, sf):
    return association.mixed_association(_kinds_frame(spark, sf), "survey_id", _MIXED)


@query("g7_symmetric_cells", SQL_MIXED + ' SELECT * FROM mix UNION ALL SELECT "right", "left", metric, value, n FROM mix')
def _g7(spark, sf):
    return association.symmetric(association.mixed_association(_kinds_frame(spark, sf), "survey_id", _MIXED))


@query(
    "g8_spearman_matrix",
    " UNION ALL ".join(sql_spearman(ITEMS[a], ITEMS[b], "survey") for a in range(9) for b in range(a + 1, 9)),
)
def _g8(spark, sf):
    return association.spearman_matrix(survey(spark, sf), ITEMS)


# --- psychometrics and contradiction --------------------------------------------------------------------------------------------


def _alpha_sql(factor: str, dropped: str, items: list[str]) -> str:
    k = len(items)
    where = " AND ".join(f"{i} IS NOT NULL" for i in items)
    total = "var_samp((" + " + ".join(items) + ")::DOUBLE)"
    parts = " + ".join(f"var_samp({i}::DOUBLE)" for i in items)
    value = f"CASE WHEN {total} > 0 THEN greatest(-1.0, least(1.0, {k / (k - 1)!r}::DOUBLE * (1.0 - ({parts}) / {total}))) END"
    return f"SELECT '{factor}' AS factor, '{dropped}' AS dropped, {r(value, 6)} AS alpha, count(*) AS n FROM survey WHERE {where}"


_FULL = [(f, "", items) for f, items in FACTORS.items()]
_LEFT = [(f, d, [i for i in items if i != d]) for f, items in FACTORS.items() for d in items]


def _alphas(spark, sf):
    return psychometrics.cronbach_alpha(survey(spark, sf)).withColumn("alpha", rounded(F.col("alpha"), 6))


@query("h1_cronbach_alpha", " UNION ALL ".join(_alpha_sql(*s) for s in _FULL))
def _h1(spark, sf):
    return _alphas(spark, sf).where(F.col("dropped") == "")


@query("h2_alpha_if_deleted", " UNION ALL ".join(_alpha_sql(*s) for s in _LEFT))
def _h2(spark, sf):
    return _alphas(spark, sf).where(F.col("dropped") != "")


# A loading table derived from the data: correlation of every item with every factor's item sum.
SQL_LOADINGS = "ld AS (" + " UNION ALL ".join(
    f"SELECT '{i}' AS item, '{f}' AS factor, {r('corr(' + i + ', ' + ' + '.join(items) + ')', 6)} AS loading FROM survey WHERE {' AND '.join(x + ' IS NOT NULL' for x in ITEMS)}"
    for i in ITEMS
    for f, items in FACTORS.items()
) + ")"


def _loadings(spark, sf):
    rows = survey(spark, sf).select(*ITEMS).dropna()
    sums = {f: sum((F.col(i) for i in items[1:]), F.col(items[0])) for f, items in FACTORS.items()}
    cells = [(i, f) for i in ITEMS for f in FACTORS]
    one = rows.agg(*[F.corr(i, sums[f]).alias(f"_{k}") for k, (i, f) in enumerate(cells)])
    pairs = [
        F.struct(F.lit(i).alias("item"), F.lit(f).alias("factor"), rounded(F.col(f"_{k}"), 6).alias("loading"))
        for k, (i, f) in enumerate(cells)
    ]
    return one.select(F.inline(F.array(*pairs)))


@query(
    "h3_mcdonald_omega",
    f"WITH {SQL_LOADINGS}, s AS (SELECT factor, sum(loading) AS s, sum(1.0 - loading * loading) AS u FROM ld GROUP BY 1) SELECT factor, {r('greatest(0.0, least(1.0, s * s / (s * s + u)))', 6)} AS omega FROM s",
)
def _h3(spark, sf):
    return psychometrics.mcdonald_omega(_loadings(spark, sf)).withColumn("omega", rounded(F.col("omega"), 6))


@query(
    "h4_reliability_report",
    f"""WITH {SQL_LOADINGS}, s AS (SELECT factor, sum(loading) AS s, sum(1.0 - loading * loading) AS u FROM ld GROUP BY 1), al AS ({" UNION ALL ".join(_alpha_sql(*s) for s in _FULL + _LEFT)})
    SELECT factor, CASE WHEN dropped = '' THEN 'alpha' ELSE 'alpha_if_deleted' END AS metric, dropped AS item, alpha AS value FROM al
    UNION ALL SELECT factor, 'omega', '', {r("greatest(0.0, least(1.0, s * s / (s * s + u)))", 6)} FROM s""",
)
def _h4(spark, sf):
    report = psychometrics.reliability_report(survey(spark, sf), _loadings(spark, sf))
    return report.withColumn("value", rounded(F.col("value"), 6))


@query("h5_confirmatory_loadings")
def _h5(spark, sf):
    return psychometrics.fit_factor_model(survey(spark, sf)).loading_rows(spark)


@query("h6_fit_indices")
def _h6(spark, sf):
    model = psychometrics.fit_factor_model(survey(spark, sf))
    return spark.createDataFrame([(k, float(v)) for k, v in model.fit.items()], "metric string, value double")


@query("h7_exploratory_loadings")
def _h7(spark, sf):
    m = psychometrics.moments(survey(spark, sf), ITEMS)
    loadings, _, summary = psychometrics.exploratory_fit(m, 3)
    rows = [(i, str(b), float(loadings[a, b]), float(summary["communalities"][a])) for a, i in enumerate(ITEMS) for b in range(3)]
    return spark.createDataFrame(rows, "item string, factor string, loading double, communality double")


@query(
    "h8_factor_alignment",
    f"""WITH {SQL_LOADINGS}, own AS (SELECT item, factor AS target FROM (VALUES {", ".join(f"('{i}', '{f}')" for f, items in FACTORS.items() for i in items)}) v(item, factor)),
    m AS (SELECT target, ld.factor AS source, avg(abs(loading)) AS v FROM ld JOIN own USING (item) GROUP BY ALL),
    a1 AS (SELECT target, source, v FROM m WHERE target = 'program_quality' ORDER BY v DESC, source LIMIT 1),
    a2 AS (SELECT target, source, v FROM m WHERE target = 'resources_teaching' AND source NOT IN (SELECT source FROM a1) ORDER BY v DESC, source LIMIT 1),
    a3 AS (SELECT target, source, v FROM m WHERE target = 'digital_assessment' AND source NOT IN (SELECT source FROM a1 UNION ALL SELECT source FROM a2) ORDER BY v DESC, source LIMIT 1)
    SELECT target, source, {r("v", 6)} AS mean_abs FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3)""",
)
def _h8(spark, sf):
    aligned = psychometrics.align_factors(_loadings(spark, sf))
    return aligned.withColumn("mean_abs", rounded(F.col("mean_abs"), 6))


@query("h9_factor_scores", f"WITH {SQL_SCORES} SELECT survey_id, {', '.join(r(f, 6) + f' AS {f}' for f in FACTORS)} FROM scores")
def _h9(spark, sf):
    return fixed_scores(spark, sf).select("survey_id", *[rounded(F.col(f), 6).alias(f) for f in FACTORS])


@query(
    "h10_score_error",
    f"WITH {SQL_SCORES}, res AS ("
    + " UNION ALL ".join(
        f"SELECT {_Z[i]} - {f} AS d FROM complete JOIN scores USING (survey_id), mom" for f, items in FACTORS.items() for i in items
    )
    + f") SELECT {r('stddev_pop(d)', 6)} AS score_se, count(*) // 9 AS n FROM res",
)
def _h10(spark, sf):
    m = psychometrics.moments(survey(spark, sf), ITEMS)
    return spark.createDataFrame([(psychometrics.score_error(m, LOADINGS), m.n)], "score_se double, n bigint").withColumn(
        "score_se", rounded(F.col("score_se"), 6)
    )


@query("h11_psychometrics_job")
def _h11(spark, sf):
    report = psychometrics.psychometrics_report(survey(spark, sf))
    scores = report["scores"].select(
        F.lit("scores").alias("part"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("value")) for f in FACTORS])),
    )
    scores = scores.groupBy("part", "name").agg(F.avg("value").alias("value"))
    parts = [
        scores,
        report["loadings"].select(F.lit("loadings").alias("part"), F.concat_ws("/", "item", "factor").alias("name"), F.col("loading").alias("value")),
        report["fit"].select(F.lit("fit").alias("part"), F.col("metric").alias("name"), "value"),
        report["reliability"].select(F.lit("reliability").alias("part"), F.concat_ws("/", "factor", "metric", "item").alias("name"), "value"),
        report["correlations"].select(F.lit("correlations").alias("part"), F.concat_ws("/", "left", "right").alias("name"), "value"),
    ]
    return union(parts)


@query(
    "i1_score_thresholds",
    f"WITH {SQL_SCORES} " + " UNION ALL ".join(f"SELECT '{f}' AS factor, {r(f'quantile_cont({f}, 0.1)', 6)} AS low, {r(f'quantile_cont({f}, 0.9)', 6)} AS high FROM scores" for f in FACTORS),
)
def _i1(spark, sf):
    marks = contradiction.score_thresholds(fixed_scores(spark, sf), list(FACTORS))
    return marks.select("factor", rounded(F.col("low"), 6).alias("low"), rounded(F.col("high"), 6).alias("high"))


@query("i2_contradiction_flags", f"WITH {SQL_FLAGS} SELECT * FROM flags")
def _i2(spark, sf):
    return _flags(spark, sf)[0]


@query(
    "i3_monitoring_job",
    f"""WITH {SQL_FLAGS}, rt AS (SELECT dimension, level, count(*) AS n, count(*) FILTER (WHERE hit) AS n_flagged FROM ({SQL_RATES}) GROUP BY ALL)
    SELECT dimension, level, n, n_flagged, (SELECT count(*) FROM flags WHERE is_contradiction) AS flagged_rows FROM rt""",
)
def _i3(spark, sf):
    flags, _ = _flags(spark, sf)
    stored = settle(flags, "flags")
    rates = contradiction.contradiction_rates(stored).drop("rate")
    return with_scalars(rates, stored.agg(F.count_if("is_contradiction").alias("flagged_rows")))


# --- sampling -----------------------------------------------------------------------------------------------------------------------


@query(
    "j1_stratified_split",
    f"WITH {SQL_SPLIT.format(s='sentiment_class', t='survey', k='survey_id')} SELECT survey_id, sentiment_class, split FROM split",
)
def _j1(spark, sf):
    return sampling.stratified_split(survey(spark, sf).select("survey_id", "sentiment_class"))


@query(
    "j2_oversampling",
    "WITH c AS (SELECT sentiment_class, count(*) AS n FROM survey WHERE sentiment_class IS NOT NULL GROUP BY 1) SELECT sentiment_class, (SELECT max(n) FROM c) AS n, n AS originals, n AS distinct_originals FROM c",
)
def _j2(spark, sf):
    rows = survey(spark, sf).select("survey_id", "sentiment_class").where(F.col("sentiment_class").isNotNull())
    grown = sampling.oversample(rows, "sentiment_class", "survey_id")
    return grown.groupBy("sentiment_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("draw") == 0).alias("originals"),
        F.count_distinct(F.when(F.col("draw") == 0, F.col("survey_id"))).alias("distinct_originals"),
    )


@query(
    "j3_permuted_texts",
    """WITH a AS (SELECT survey_id, row_number() OVER (ORDER BY survey_id) AS i FROM survey), b AS (SELECT text_feedback, row_number() OVER (ORDER BY md5(CAST(survey_id AS VARCHAR) || ':42'), survey_id) AS i FROM survey)
    SELECT survey_id, md5(text_feedback) AS text_md5 FROM a JOIN b USING (i)""",
)
def _j3(spark, sf):
    moved = sampling.permute_within(survey(spark, sf).select("survey_id", "text_feedback"), "survey_id", ["text_feedback"])
    return moved.select("survey_id", F.md5("text_feedback").alias("text_md5"))


@query("j4_bootstrap_resampling", f"SELECT count(o_totalprice) AS n, {r('sum(o_totalprice)', 2)} AS estimate, true AS inside, 200 AS n_resamples FROM orders")
def _j4(spark, sf):
    return _bracketed(profile.bootstrap_interval(table(spark, sf, "orders"), F.col("o_totalprice"), "sum", n_resamples=200), 2)


@query(
    "j5_split_by_any_label",
    f"WITH {SQL_SPLIT.format(s='o_orderpriority', t='orders', k='o_orderkey')} SELECT o_orderpriority, split, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS id_sum FROM split GROUP BY ALL",
)
def _j5(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    parts = sampling.stratified_split(rows, "o_orderpriority", "o_orderkey")
    return parts.groupBy("o_orderpriority", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("id_sum"))


# --- windows ------------------------------------------------------------------------------------------------------------------------


@query("l1_next_versions", f"WITH {SQL_VERSIONS} SELECT dataset, o_orderkey, version FROM versions")
def _l1(spark, sf):
    return _versions(spark, sf).select("dataset", "o_orderkey", "version")


@query(
    "l2_branch_heads",
    f"WITH {SQL_VERSIONS} SELECT dataset, version, o_orderkey FROM vh WHERE is_live QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY is_head DESC, version DESC) = 1",
)
def _l2(spark, sf):
    return branch_heads(_versions(spark, sf), ["dataset"]).select("dataset", "version", "o_orderkey")


@query(
    "l3_version_history",
    f"WITH {SQL_VERSIONS} SELECT dataset, version, row_number() OVER (PARTITION BY dataset ORDER BY is_head DESC, version DESC) AS position FROM vh",
)
def _l3(spark, sf):
    versions = settle(_versions(spark, sf), "versions")
    newest_first = F.floor(-F.col("version") / F.lit(1000)) + 1_000_000
    return version_history(versions, ["dataset"], newest_first).select("dataset", "version", "position")


@query(
    "l4_recent_per_owner",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders QUALIFY rank <= 5",
)
def _l4(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    top = ranks.top_per_group(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    return top.select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query(
    "l5_average_ranks",
    "SELECT DISTINCT l_extendedprice AS value, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS average_rank FROM lineitem",
)
def _l5(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.lit("l_extendedprice").alias("column"), "l_extendedprice")
    ranked = ranks.average_ranks(ranks.value_counts(rows, ["column"], F.col("l_extendedprice")), ["column"])
    return ranked.select(F.col("_v").alias("value"), F.col("_rank").alias("average_rank"))


@query("l6_dense_row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders WHERE o_orderstatus <> 'P'")
def _l6(spark, sf):
    return ranks.dense_index(table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey"), "o_orderkey")


@query("l7_share_of_total", f"SELECT o_orderpriority AS label, count(*) AS n, {r('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS share FROM orders GROUP BY 1")
def _l7(spark, sf):
    return profile.shares(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "m5_top_sections",
    sql_frequency(["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_partkey"], "lineitem", 8)
    + """, big AS (SELECT DISTINCT "column", count FROM fr ORDER BY count DESC, "column" LIMIT 4) SELECT "column", count, rank, level, level_count FROM fr WHERE "column" IN (SELECT "column" FROM big)""",
)
def _m5(spark, sf):
    levels = profile.categorical_frequency(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_partkey"])
    return profile.top_sections(levels)


# --- set operations --------------------------------------------------------------------------------------------------------------


@query(
    "n1_append_rows",
    "SELECT language, detail_level, coalesce(sentiment_class, '') AS sentiment_class, count(*) AS n FROM survey GROUP BY ALL UNION ALL SELECT event_type, '', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY ALL",
)
def _n1(spark, sf):
    base = _cells(spark, sf).drop("row_idx")
    new = table(spark, sf, "events").select(F.col("event_type").alias("language"), F.col("user_id").alias("sentiment_class"), "value")
    return align.append_rows(base, new).groupBy("language", "detail_level", "sentiment_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "n2_shared_tasks",
    "SELECT DISTINCT event_type AS task FROM events WHERE user_id % 2 = 0 INTERSECT SELECT event_type FROM events WHERE user_id % 2 = 1",
)
def _n2(spark, sf):
    tasks = table(spark, sf, "events").withColumnRenamed("event_type", "task")
    return compare.shared_tasks(tasks.where("user_id % 2 = 0"), tasks.where("user_id % 2 = 1"))


@query("n3_class_union", "SELECT sentiment_class AS label FROM pred UNION SELECT y_pred FROM pred UNION SELECT language FROM pred")
def _n3(spark, sf):
    p = predictions(spark, sf)
    parts = [p.select(F.col(c).alias("label")) for c in ("sentiment_class", "y_pred", "language")]
    return compare.class_union(*parts)


@query("n4_unexpected_values", "SELECT DISTINCT language AS value FROM survey WHERE language NOT IN ('en', 'ru', 'kz')")
def _n4(spark, sf):
    allowed = spark.createDataFrame([("en",), ("ru",), ("kz",)], "value string")
    observed = survey(spark, sf).where(F.col("language").isNotNull()).select(F.col("language").alias("value"))
    return observed.join(allowed, "value", "left_anti").distinct()

