"""Queries: scans and sinks, schema, filters, scalar functions, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import text as T
from surveyloom.functions.intervals import T_95, t_critical
from surveyloom.functions.numbers import blank_to_empty, clip, rounded, softmax, to_number
from surveyloom.operators import predicates as P
from surveyloom.operators import schema as S
from surveyloom.operators import sketches
from surveyloom.operators.align import append_rows
from surveyloom.operators.classify import pooled_vectors
from surveyloom.operators.features import term_bags, word_terms
from surveyloom.operators.profile import column_profile, segment_stats
from surveyloom.operators.sampling import stratified_split
from surveyloom.operators.versions import commit, fingerprint, read_standardized
from surveyloom.plans.registry import query, r
from surveyloom.session import scratch_path, settle
from surveyloom.sources import files
from surveyloom.sources.tables import ITEMS, LABELS, SURVEY_COLUMNS, results, survey, table

B = T.BLANK
Q2 = T.QUOTES.replace("'", "''")
S2 = T.STRAIGHT_QUOTES.replace("'", "''")


def sql_normalize(x: str) -> str:
    x = f"translate(translate(nfc_normalize({x}), '{Q2}', '{S2}'), '{T.DASHES}', '-----')"
    x = rf"regexp_replace({x}, '\x{{2026}}|\.{{4,}}', '...', 'g')"
    return f"trim(regexp_replace({x}, '[{B}{T.INVISIBLE}]+', ' ', 'g'))"


def sql_pattern(kind: str) -> str:
    return T.REDACTIONS[kind].replace("(?U)", "")


def sql_redact(x: str, kinds=tuple(T.REDACTIONS)) -> str:
    for kind in kinds:
        x = f"regexp_replace({x}, '{sql_pattern(kind)}', '[REDACTED]', 'g')"
    return x


def sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def sql_words(x: str) -> str:
    return sql_count(x, f"[^{B}]+")


def sql_features(x: str) -> str:
    letters = f"length(regexp_replace({x}, '[{B}]+', '', 'g'))"
    return f"""length({x}) AS char_count, {sql_words(x)} AS word_count,
      CASE WHEN {x} = '' THEN 0 ELSE greatest(1, {sql_count(x, f"[^.!?{B}][^.!?]*")}) END AS sentence_count,
      CASE WHEN {sql_words(x)} > 0 THEN {r(f"{letters}::DOUBLE / {sql_words(x)}", 2)} ELSE 0.0::DOUBLE END AS avg_word_length"""


SQL_PREPROCESSED = f"""prep AS (SELECT *, {sql_redact(sql_normalize("text_feedback"))} AS text_processed FROM survey),
  feat AS (SELECT *, {sql_features("text_processed")} FROM prep)"""

def not_blank(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), '[^{B}]')"


# --- flagship ---------------------------------------------------------------------------------------------------------


@query(
    "flagship_words_by_language",
    f"""WITH {SQL_PREPROCESSED}
    SELECT language AS "group", count(*) AS count, {r("avg(word_count)")} AS mean, {r("quantile_cont(word_count, 0.5)")} AS median,
      {r("CASE WHEN count(*) > 1 THEN stddev_samp(word_count) ELSE 0 END")} AS std
    FROM feat WHERE lower(detail_level) <> 'short' AND char_count >= 100 GROUP BY language""",
)
def _flagship(spark, sf):
    cleaned = T.preprocess(T.spread(survey(spark, sf).select("language", "detail_level", "text_feedback")))
    features = settle(cleaned.select("language", "detail_level", "char_count", "word_count"), "features")
    rules = [{"col": "detail_level", "op": "ne", "val": "Short"}, {"col": "char_count", "op": "gte", "val": "100"}]
    return segment_stats(P.filter_rows(features, rules), "language", "word_count")


# --- scans and sinks ----------------------------------------------------------------------------------------------------

_TYPED = "survey_id, " + ", ".join(ITEMS) + ", language, detail_level, sentiment_class"


def _survey_csv(spark, sf) -> str:
    """The survey as a CSV file with the questionnaire's own headers, one of them ending in a line break."""
    names = {short: header for header, short in S.HEADERS.items()}
    frame = survey(spark, sf).select(
        [F.col(c).alias(names[c] + ("\n" if c == "text_feedback" else "")) for c in SURVEY_COLUMNS]
    )
    path = scratch_path(spark, "survey-csv")
    files.write_strings(frame.withColumn("extra", F.lit("x")), path)
    return path


@query("a1_typed_survey_scan", f"SELECT {_TYPED}, md5(text_feedback) AS text_md5, length(text_feedback) AS n FROM survey")
def _a1(spark, sf):
    frame = files.read_survey(spark, _survey_csv(spark, sf))
    return frame.select(
        "survey_id", *ITEMS, *LABELS, F.md5("text_feedback").alias("text_md5"), F.length("text_feedback").alias("n")
    )


@query(
    "a2_domain_validation",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 'range' AS rule, count(*) FILTER (WHERE {c} < 0 OR {c} > 8) AS n_bad FROM survey" for c in ITEMS
    )
    + """ UNION ALL SELECT 'language', 'domain', count(*) FILTER (WHERE language NOT IN ('en', 'fr')) FROM survey
    UNION ALL SELECT 'detail_level', 'domain', count(*) FILTER (WHERE detail_level NOT IN ('short', 'medium', 'long')) FROM survey
    UNION ALL SELECT 'sentiment_class', 'domain', count(*) FILTER (WHERE sentiment_class NOT IN ('positive', 'neutral', 'negative')) FROM survey)""",
)
def _a2(spark, sf):
    return files.validate_survey(
        survey(spark, sf), domains={**files.DOMAINS, "language": ["en", "fr"]}, item_range=(0, 8)
    )


@query(
    "a3_structure_check",
    "SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_columns, count(*) FILTER (WHERE "
    + " AND ".join(f"{c} IS NULL" for c in [*ITEMS, "sentiment_class"])
    + ") AS n_empty_rows FROM survey",
)
def _a3(spark, sf):
    return files.structure_counts(survey(spark, sf).select(*ITEMS, "sentiment_class"))


_BROKEN = ["survey_id", "text_feedback", "language", "item_1"]
_UNNAMED = [c for c in SURVEY_COLUMNS if c not in _BROKEN]


@query(
    "a3_broken_csv",
    """WITH d AS (SELECT *, doc_id % 17 AS k, doc_id % 13 AS item FROM documents), good AS (SELECT * FROM d WHERE k NOT IN (3, 5)), filled AS (SELECT * FROM good WHERE k <> 7)
    SELECT CAST(NULL AS VARCHAR) AS "column", 'rows' AS rule, count(*) AS n_bad FROM good UNION ALL SELECT NULL, 'empty', count(*) FROM good WHERE k = 7
    UNION ALL SELECT NULL, 'malformed', count(*) FROM d WHERE k IN (3, 5) UNION ALL SELECT 'language', 'domain', count(*) FROM filled WHERE lang NOT IN ('en', 'fr')
    UNION ALL SELECT 'item_1', 'range', count(*) FROM filled WHERE item > 10"""
    + "".join(f" UNION ALL SELECT '{c}', 'missing', 1" for c in _UNNAMED),
)
def _a3b(spark, sf):
    k, item = F.col("doc_id") % 17, (F.col("doc_id") % 13).cast("string")
    text = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    fields = [F.col("doc_id").cast("string"), text, F.coalesce("lang", F.lit("")), item]
    line = F.when(k == 3, F.concat_ws(",", *fields[:2])).when(k == 5, F.concat_ws(",", *fields, F.lit("more"))).when(k == 7, ",,,").otherwise(F.concat_ws(",", *fields))
    path = scratch_path(spark, "broken-csv")
    table(spark, sf, "documents").select(line.alias("line")).write.text(path)
    marked = files.read_marked(spark, path, _BROKEN, header=False)
    return files.write_checked(marked, scratch_path(spark, "checked"), domains={**files.DOMAINS, "language": ["en", "fr"]})


@query(
    "a4_string_scan_null_policies",
    """WITH raw AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'NA' WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 = 2 THEN 'null' ELSE lang END AS a FROM documents)
    SELECT 'default' AS policy, coalesce(CASE WHEN a IN ('NA', '', 'null') THEN NULL ELSE a END, '<null>') AS value, count(*) AS n FROM raw GROUP BY 2
    UNION ALL SELECT 'keep', a, count(*) FROM raw GROUP BY 2""",
)
def _a4(spark, sf):
    k = F.col("doc_id") % 5
    raw = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(k == 0, "NA").when(k == 1, "").when(k == 2, "null").otherwise(F.col("lang")).alias("a"),
        "source",
    )
    path = scratch_path(spark, "strings")
    files.write_strings(raw, path)

    def counted(policy: str, keep: bool):
        rows = files.read_strings(spark, path, keep_default_na=keep)
        value = F.coalesce(F.col("a"), F.lit("<null>")).alias("value")
        return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).select(F.lit(policy).alias("policy"), "value", "n")

    return counted("default", True).unionByName(counted("keep", False))


_PROFILED = [*ITEMS, "text_feedback", *LABELS]


@query(
    "a5_column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{"int" if c in ITEMS else "string"}' AS dtype, count(DISTINCT {c}) AS n_unique, count(*) FILTER (WHERE {c} IS NULL) AS n_null,
    (SELECT string_agg(v, '|' ORDER BY survey_id) FROM (SELECT survey_id, CAST({c} AS VARCHAR) AS v FROM survey WHERE {c} IS NOT NULL ORDER BY survey_id LIMIT 5)) AS sample_values FROM survey"""
        for c in _PROFILED
    ),
)
def _a5(spark, sf):
    return column_profile(survey(spark, sf), "survey_id", _PROFILED).withColumn(
        "sample_values", F.array_join("sample_values", "|")
    )


@query(
    "a5_merged_sketches",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_unique, """
        + (
            f"count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'CASE WHEN count({c}) > 1 THEN stddev_samp({c}) ELSE 0 END')} AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM survey"
            if c in ITEMS
            else "0 AS count, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max FROM survey"
        )
        for c in [*ITEMS, *LABELS]
    ),
)
def _a5b(spark, sf):
    rows, columns = survey(spark, sf).select(*ITEMS, *LABELS), [*ITEMS, *LABELS]
    english = F.coalesce(F.col("language") == "en", F.lit(False))
    earlier = scratch_path(spark, "sketches")
    sketches.store_sketches(sketches.sketch_columns(rows.where(english), columns), earlier)
    grown = sketches.grown_profile(spark, earlier, rows.where(~english), columns, scratch_path(spark, "sketches"))
    return sketches.sketched_profile(grown).drop("q25", "median", "q75")


@query(
    "a6_snapshot_fingerprint",
    "WITH h AS (SELECT sha256(concat_ws(chr(31), "
    + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in SURVEY_COLUMNS)
    + """)) AS d FROM survey), s AS (SELECT count(*) AS n_rows, CAST(sum(('0x' || substr(d, 1, 12))::BIGINT) AS VARCHAR) AS checksum FROM h)
    SELECT n_rows, checksum, substr(sha256(CAST(n_rows AS VARCHAR) || ':' || checksum), 1, 16) AS snapshot_id FROM s""",
)
def _a6(spark, sf):
    return fingerprint(survey(spark, sf).select(SURVEY_COLUMNS))


SQL_SPLIT = """strata AS (SELECT {s} AS stratum, count(*) AS size FROM {t} WHERE {s} IS NOT NULL GROUP BY 1),
  q1 AS (SELECT *, CAST(size AS DOUBLE) / sum(size) OVER () * ceil(0.1::DOUBLE * sum(size) OVER ()) AS quota, ceil(0.1::DOUBLE * sum(size) OVER ()) AS places FROM strata),
  t1 AS (SELECT stratum, size, floor(quota) + CASE WHEN row_number() OVER (ORDER BY quota - floor(quota) DESC, stratum) <= places - sum(floor(quota)) OVER () THEN 1 ELSE 0 END AS test FROM q1),
  q2 AS (SELECT *, size - test AS rest, ceil(0.1::DOUBLE / (0.8::DOUBLE + 0.1::DOUBLE) * sum(size - test) OVER ()) AS places,
    CAST(size - test AS DOUBLE) / sum(size - test) OVER () * ceil(0.1::DOUBLE / (0.8::DOUBLE + 0.1::DOUBLE) * sum(size - test) OVER ()) AS quota FROM t1),
  t2 AS (SELECT stratum, test, floor(quota) + CASE WHEN row_number() OVER (ORDER BY quota - floor(quota) DESC, stratum) <= places - sum(floor(quota)) OVER () THEN 1 ELSE 0 END AS val FROM q2),
  split AS (SELECT r.*, CASE WHEN rk <= test THEN 'test' WHEN rk <= test + val THEN 'val' ELSE 'train' END AS split FROM
    (SELECT *, row_number() OVER (PARTITION BY {s} ORDER BY md5(CAST({k} AS VARCHAR) || ':42'), {k}) AS rk FROM {t} WHERE {s} IS NOT NULL) r JOIN t2 ON t2.stratum = r.{s})"""


@query(
    "a7_partitioned_sink",
    f"WITH {SQL_SPLIT.format(s='sentiment_class', t='survey', k='survey_id')} SELECT split, count(*) AS n, CAST(sum(survey_id) AS BIGINT) AS id_sum FROM split GROUP BY split",
)
def _a7(spark, sf):
    path = scratch_path(spark, "split")
    files.write_partitioned(stratified_split(T.preprocess(survey(spark, sf))), path, "split")
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("survey_id").alias("id_sum"))


@query(
    "a8_filtered_export",
    """SELECT f.fmt, row_idx, language, sentiment_pred, sentiment_conf FROM results, (VALUES ('csv'), ('json')) f(fmt)
    WHERE sentiment_conf >= 0.5 AND contains(lower(language), 'e')""",
)
def _a8(spark, sf):
    rules = [{"col": "sentiment_conf", "op": "gte", "val": "0.5"}, {"col": "language", "op": "contains", "val": "E"}]
    columns = ["row_idx", "language", "sentiment_pred", "sentiment_conf"]
    chosen = P.filter_rows(results(spark, sf), rules).select(columns).orderBy(F.col("sentiment_conf").cast("string"), "row_idx")
    parts = []
    for fmt in ("csv", "json"):
        path = scratch_path(spark, fmt)
        files.write_export(chosen, path, fmt)
        back = files.read_export(spark, path, fmt, columns)
        parts.append(
            back.select(
                F.lit(fmt).alias("fmt"),
                F.col("row_idx").cast("bigint").alias("row_idx"),
                "language",
                "sentiment_pred",
                F.col("sentiment_conf").cast("double").alias("sentiment_conf"),
            )
        )
    return parts[0].unionByName(parts[1])


@query(
    "a9_paged_preview",
    """SELECT survey_id, coalesce(CAST(item_1 AS VARCHAR), '') AS item_1, coalesce(sentiment_class, '') AS sentiment_class, language,
    (SELECT count(*) FROM survey) AS total FROM survey WHERE survey_id BETWEEN 100 AND 149""",
)
def _a9(spark, sf):
    frame = survey(spark, sf)
    rows = files.page(frame.select("survey_id", "item_1", "sentiment_class", "language"), 100, 50, "survey_id")
    from surveyloom.operators.common import with_scalars

    return with_scalars(rows, frame.agg(F.count(F.lit(1)).alias("total")))


@query(
    "a9_page_of_sorted_view",
    """SELECT row_idx, sentiment_pred, sentiment_conf FROM results ORDER BY CAST(sentiment_conf AS VARCHAR) DESC, row_idx LIMIT 20 OFFSET 40""",
)
def _a9b(spark, sf):
    order = sort_order("sentiment_conf", ascending=False)
    return files.page_by_order(results(spark, sf), order, 40, 20).select("row_idx", "sentiment_pred", "sentiment_conf")


@query(
    "a10_empty_table_append",
    """SELECT lang AS language, '' AS comment, count(*) AS n FROM documents GROUP BY 1""",
)
def _a10(spark, sf):
    empty = files.empty_table(spark, ["language", "comment"])
    grown = append_rows(empty, table(spark, sf, "documents").select(F.col("lang").alias("language"), "doc_id"))
    return grown.groupBy("language", "comment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a11_standardized_version_scan",
    """SELECT language, detail_level, sentiment_class, count(*) AS n, CAST(sum(length(text_feedback)) AS BIGINT) AS chars FROM survey GROUP BY ALL""",
)
def _a11(spark, sf):
    root = scratch_path(spark, "store")
    renamed = survey(spark, sf).select(
        "survey_id",
        F.col("text_feedback").alias("free_text"),
        F.col("language").alias("Язык"),
        F.col("detail_level").alias("Length"),
        F.col("sentiment_class").alias("tone"),
    )
    commit(renamed.limit(0), root, "feedback", 1)
    commit(renamed, root, "feedback", 2, roles={"free_text": "text", "tone": "sentiment"})
    frame = read_standardized(spark, root, "feedback")
    return frame.groupBy(*LABELS).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text_feedback")).alias("chars")
    )


# --- projections ----------------------------------------------------------------------------------------------------------


@query("b1_header_normalization", f"SELECT {_TYPED} FROM survey")
def _b1(spark, sf):
    names = {short: header for header, short in S.HEADERS.items()}
    padded = survey(spark, sf).select(
        [F.col(c).alias(f"  {names[c]}\n") for c in SURVEY_COLUMNS if c != "text_feedback"]
    )
    return S.normalize_headers(padded)


@query(
    "b3_role_standardization",
    "SELECT survey_id, md5(text_feedback) AS text_md5, language, sentiment_class, detail_level FROM survey",
)
def _b3(spark, sf):
    frame = survey(spark, sf).select(
        "survey_id",
        F.col("text_feedback").alias("free_text"),
        F.col("language").alias("Язык"),
        F.col("sentiment_class").alias("tone_label"),
        F.col("detail_level").alias("length"),
    )
    done = S.standardize(frame, {"free_text": "text", "tone_label": "sentiment"})
    return done.select("survey_id", F.md5("text_feedback").alias("text_md5"), "language", "sentiment_class", "detail_level")


@query(
    "b3_inferred_roles",
    " UNION ALL ".join(
        f"""SELECT '{header}' AS "column", '{role}' AS role, count(*) FILTER (WHERE trim({c}) <> '') AS n_filled FROM survey"""
        for header, role, c in [("  comment ", "text", "text_feedback"), ("Язык", "language", "language"), ("sentiment", "sentiment", "sentiment_class"), ("Length", "detail_level", "detail_level")]
    ),
)
def _b3b(spark, sf):
    frame = survey(spark, sf).select(
        "survey_id",
        F.col("text_feedback").alias("  comment "),
        F.col("language").alias("Язык"),
        F.col("sentiment_class").alias("sentiment"),
        F.col("detail_level").alias("Length"),
        "item_1",
    )
    return S.role_report(frame)


@query(
    "b5_rename_columns",
    "SELECT survey_id AS id, language AS lang_code, 'lang_code' AS language_role, detail_level FROM survey",
)
def _b5(spark, sf):
    frame = survey(spark, sf).select("survey_id", "language", "detail_level")
    renamed, roles = S.rename_columns(frame, {"survey_id": "id", "language": "lang_code"}, {"language": "language"})
    holder = next(c for c, role in roles.items() if role == "language")
    return renamed.withColumn("language_role", F.lit(holder))


@query("b7_label_projection", "SELECT row_idx, language, detail_level, sentiment_class, sentiment_pred FROM results")
def _b7(spark, sf):
    frame = results(spark, sf)
    return frame.select("row_idx", *S.label_columns(frame))


# --- filters --------------------------------------------------------------------------------------------------------------

_SHOWN = "row_idx, language, sentiment_pred, sentiment_conf"


def _show(df):
    return df.select("row_idx", "language", "sentiment_pred", "sentiment_conf")


@query(
    "c1_rule_filter",
    f"""SELECT {_SHOWN} FROM results WHERE lower(coalesce(language, '')) = 'en' AND lower(coalesce(sentiment_pred, '')) <> 'negative'
    AND contains(lower(coalesce(detail_level, '')), 'o') AND item_1 > 3 AND sentiment_conf <= 0.9""",
)
def _c1(spark, sf):
    rules = [
        {"col": "language", "op": "eq", "val": "EN"},
        {"col": "sentiment_pred", "op": "ne", "val": "Negative"},
        {"col": "detail_level", "op": "contains", "val": "O"},
        {"col": "item_1", "op": "gt", "val": "3"},
        {"col": "sentiment_conf", "op": "lte", "val": "0.9"},
        {"col": "item_2", "op": "lt", "val": "many"},
        {"col": "nowhere", "op": "eq", "val": "x"},
        {"col": "language", "op": "like", "val": "x"},
    ]
    return _show(P.filter_rows(results(spark, sf), rules))


@query("c2_single_equality_filter", f"SELECT {_SHOWN} FROM results WHERE lower(coalesce(sentiment_class, '')) = 'neutral'")
def _c2(spark, sf):
    return _show(P.filter_rows(results(spark, sf), column="sentiment_class", value="NEUTRAL"))


@query(
    "c3_full_text_search",
    f"""SELECT {_SHOWN} FROM results WHERE contains(lower(text_feedback), 'the') OR contains(lower(language), 'the') OR contains(lower(detail_level), 'the')
    OR contains(lower(coalesce(sentiment_class, '')), 'the') OR contains(lower(coalesce(sentiment_pred, '')), 'the')""",
)
def _c3(spark, sf):
    return _show(P.filter_rows(results(spark, sf), search="The"))


@query(
    "c4_subset_filter",
    """SELECT survey_id, language FROM survey WHERE language IN ('en', 'de') AND detail_level = 'short' AND regexp_matches(text_feedback, '(?i)th[ae]|ei')""",
)
def _c4(spark, sf):
    config = {
        "column_in": {"language": ["en", "de"]},
        "column_equals": {"detail_level": "short", "nowhere": "x"},
        "column_contains": {"text_feedback": "TH[AE]|ei"},
    }
    return P.subset(survey(spark, sf), config).select("survey_id", "language")


@query(
    "c4_subset_by_position",
    """SELECT survey_id, language FROM (SELECT *, row_number() OVER (ORDER BY survey_id) - 1 AS p FROM survey WHERE language = 'en') WHERE p IN (0, 3, 17, 40, 41, 100)""",
)
def _c4b(spark, sf):
    config = {"column_equals": {"language": "en"}, "row_indices": [0, 3, 17, 40, 41, 100, -1, 10**9]}
    return P.subset(survey(spark, sf), config, "survey_id").select("survey_id", "language")


_ANOMALOUS = f"""bad AS (SELECT row_idx, concat_ws('; ', CASE WHEN sentiment_conf < 0.6 THEN printf('low_confidence(sentiment_conf=%.3f)', sentiment_conf) END,
  CASE WHEN NOT {not_blank("text_feedback")} THEN 'empty_text(text_feedback)' END) AS reasons FROM results)"""


@query(
    "c5_result_anomalies",
    f"WITH {_ANOMALOUS}, hit AS (SELECT * FROM bad WHERE reasons <> '') SELECT row_idx, reasons, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY row_idx LIMIT 500",
)
def _c5(spark, sf):
    from surveyloom.operators.common import with_scalars

    found = P.anomalies(results(spark, sf), "text_feedback").select("row_idx", F.array_join("reasons", "; ").alias("reasons"))
    rows, total = P.capped(found, "row_idx", 500)
    return with_scalars(rows, total)


@query(
    "c6_short_and_blank_texts",
    f"""SELECT survey_id, length(text_feedback) <= 60 AS is_short, NOT {not_blank("text_feedback")} AS is_blank FROM survey
    WHERE length(text_feedback) <= 60 OR NOT {not_blank("text_feedback")}""",
)
def _c6(spark, sf):
    c = F.col("text_feedback")
    rows = survey(spark, sf).select("survey_id", P.short_text(c, 60).alias("is_short"), T.is_blank(c).alias("is_blank"))
    return rows.where(F.col("is_short") | F.col("is_blank"))


@query(
    "c7_trainable_rows",
    """WITH k AS (SELECT survey_id, trim(sentiment_class || '/' || language) AS label FROM survey WHERE sentiment_class IS NOT NULL)
    SELECT survey_id, label FROM k WHERE label IN (SELECT label FROM k GROUP BY label HAVING count(*) >= 5)""",
)
def _c7(spark, sf):
    label = F.concat(F.lit(" "), F.col("sentiment_class"), F.lit("/"), F.col("language"), F.lit("\t"))
    return P.trainable_rows(survey(spark, sf).select("survey_id", label.alias("label")), "label")


_PRESETS = {
    "sure": [{"col": "sentiment_conf", "op": "gte", "val": "0.8"}],
    "english_negative": [{"col": "language", "op": "eq", "val": "en"}, {"col": "sentiment_pred", "op": "eq", "val": "negative"}],
    "everything": [],
}


@query(
    "c8_saved_presets",
    """SELECT 'sure' AS preset, count(*) FILTER (WHERE sentiment_conf >= 0.8) AS n FROM results
    UNION ALL SELECT 'english_negative', count(*) FILTER (WHERE language = 'en' AND sentiment_pred = 'negative') FROM results
    UNION ALL SELECT 'everything', count(*) FROM results""",
)
def _c8(spark, sf):
    return P.preset_counts(results(spark, sf), _PRESETS)


@query(
    "c9_complete_rows",
    "SELECT survey_id, sentiment_class FROM survey WHERE sentiment_class IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in ITEMS),
)
def _c9(spark, sf):
    return P.complete_rows(survey(spark, sf), [*ITEMS, "sentiment_class"]).select("survey_id", "sentiment_class")


_FIND = ["text_feedback", "language", "detail_level", "sentiment_class", "sentiment_pred"]


@query(
    "c10_find_cells",
    " UNION ALL ".join(f"SELECT row_idx, '{c}' AS col FROM results WHERE contains(lower(coalesce({c}, '')), 'en')" for c in _FIND),
)
def _c10(spark, sf):
    return P.find_cells(results(spark, sf).select("row_idx", *_FIND), "EN")


# --- scalar functions -------------------------------------------------------------------------------------------------------

# Every other text is decomposed first, so that NFC has something to do.
_MARKED = "CASE WHEN doc_id % 2 = 0 THEN replace(text, 'e', 'e' || chr(769)) ELSE text END"


def _text_query(name: str, build, sql: str, source: str = "text") -> None:
    @query(name, f"SELECT doc_id, md5({sql.format(x=source)}) AS text_md5, length({sql.format(x=source)}) AS n FROM documents")
    def _run(spark, sf):
        docs = table(spark, sf, "documents")
        c = F.col("text")
        if source != "text":
            c = F.when(F.col("doc_id") % 2 == 0, F.replace(c, F.lit("e"), F.lit("e\u0301"))).otherwise(c)
        done = docs.select("doc_id", build(c).alias("t"))
        return done.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").alias("n"))


_text_query("d1_unicode_nfc", T.nfc, "nfc_normalize({x})", _MARKED)
_text_query("d2_straight_quotes", T.straighten_quotes, f"translate({{x}}, '{Q2}', '{S2}')")
_text_query("d3_unified_dashes", T.unify_dashes, f"translate({{x}}, '{T.DASHES}', '-----')")
_text_query("d4_ellipsis", T.unify_ellipsis, r"regexp_replace({x}, '\x{{2026}}|\.{{4,}}', '...', 'g')")
_text_query(
    "d5_collapsed_blanks",
    T.collapse_blanks,
    "trim(regexp_replace({x}, '[" + (B + T.INVISIBLE).replace("{", "{{").replace("}", "}}") + "]+', ' ', 'g'))",
)
_text_query("d6_normalized_text", T.normalize_text, sql_normalize("coalesce(#, '')").replace("{", "{{").replace("}", "}}").replace("#", "{x}"))
for _number, _kind in zip((7, 8, 9, 10), T.REDACTIONS, strict=True):
    _text_query(
        f"d{_number}_redact_{_kind}",
        lambda c, kind=_kind: T.redact(c, [kind]),
        sql_redact("#", [_kind]).replace("{", "{{").replace("}", "}}").replace("#", "{x}"),
    )
_text_query("d11_redact_all", T.redact, sql_redact("#").replace("{", "{{").replace("}", "}}").replace("#", "{x}"))


def _sequential_counts() -> str:
    parts, x = [], "text"
    for kind in T.REDACTIONS:
        parts.append(sql_count(x, sql_pattern(kind)))
        x = sql_redact(x, [kind])
    return " + ".join(parts)


@query("d12_redaction_count", f"SELECT doc_id, {_sequential_counts()} AS n_redacted FROM documents")
def _d12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.redaction_count(F.col("text")).alias("n_redacted"))


@query("d13_length_features", f"SELECT doc_id, {sql_features('text')} FROM documents")
def _d13(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", *[v.alias(k) for k, v in T.length_features(c).items()])


@query(
    "d14_preprocess",
    f"""WITH {SQL_PREPROCESSED} SELECT survey_id, md5(text_processed) AS text_md5, char_count, word_count, sentence_count, avg_word_length,
    'preprocess_v1' AS preprocess_spec_id FROM feat""",
)
def _d14(spark, sf):
    done = T.preprocess(T.spread(survey(spark, sf).select("survey_id", "text_feedback")))
    return done.select(
        "survey_id", F.md5("text_processed").alias("text_md5"), *T.length_features(F.col("x")), "preprocess_spec_id"
    )


@query(
    "d15_numeric_coercion",
    """WITH raw AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ' ' || CAST(value AS VARCHAR) || ' ' WHEN event_id % 4 = 1 THEN event_type
    WHEN event_id % 4 = 2 THEN 'nan' ELSE CAST(event_id AS VARCHAR) END AS t FROM events)
    SELECT event_id, CASE WHEN isnan(TRY_CAST(trim(t) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(t) AS DOUBLE) END AS number FROM raw""",
)
def _d15(spark, sf):
    k = F.col("event_id") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
        .when(k == 1, F.col("event_type"))
        .when(k == 2, F.lit("nan"))
        .otherwise(F.col("event_id").cast("string"))
    )
    return table(spark, sf, "events").select("event_id", to_number(raw).alias("number"))


SQL_TOKEN = rf"[\p{{L}}\p{{N}}_](?:[^{B}]*[\p{{L}}\p{{N}}_])?"
SQL_WORD_TERMS = f"""tok AS (SELECT {{k}} AS k, regexp_extract_all(lower({{x}}), '{SQL_TOKEN.replace("{", "{{").replace("}", "}}")}') AS t FROM {{t}}),
  w1 AS (SELECT k, unnest(t) AS term FROM tok UNION ALL SELECT k, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok),
  terms AS (SELECT k, term, count(*) AS tf FROM w1 GROUP BY ALL)"""


@query(
    "d16_word_ngrams",
    f"""WITH {SQL_WORD_TERMS.format(k="doc_id", x="text", t="documents")}
    SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS documents FROM terms GROUP BY term""",
)
def _d16(spark, sf):
    terms = word_terms(T.spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")
    return terms.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("documents"))


SQL_CHAR_TERMS = f"""cw AS (SELECT {{k}} AS k, unnest(regexp_extract_all(lower({{x}}), '[^{B.replace("{", "{{").replace("}", "}}")}]+')) AS w FROM {{t}}),
  cm AS (SELECT k, ' ' || w || ' ' AS p, count(*) AS n FROM cw GROUP BY ALL),
  cn AS (SELECT k, p, n, unnest(range({{lo}}, least({{hi}}, length(p)) + 1)) AS s FROM cm),
  cg AS (SELECT k, n, unnest(list_transform(range(1, length(p) - s + 2), lambda i: substring(p, i, s))) AS term FROM cn),
  terms AS (SELECT k, term, CAST(sum(n) AS BIGINT) AS tf FROM cg GROUP BY ALL)"""


@query(
    "d17_char_ngrams",
    f"""WITH {SQL_CHAR_TERMS.format(k="doc_id", x="text", t="documents", lo=2, hi=5)}
    SELECT k AS doc_id, count(*) AS distinct_terms, CAST(sum(tf) AS BIGINT) AS total, min(term) AS first_term, max(tf) AS most FROM terms GROUP BY k""",
)
def _d17(spark, sf):
    bags = term_bags(T.spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", "char_ngram")
    return bags.select(
        "doc_id",
        F.size("terms").cast("bigint").alias("distinct_terms"),
        F.aggregate("terms.tf", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("total"),
        F.array_min("terms.term").alias("first_term"),
        F.array_max("terms.tf").alias("most"),
    )


@query(
    "d18_critical_values",
    f"""SELECT l_suppkey, l_discount, count(*) AS n, CASE WHEN count(*) - 1 BETWEEN 1 AND 30 THEN {T_95}[CAST(count(*) - 1 AS INT)]::DOUBLE
    ELSE 1.959963984540054::DOUBLE END AS t FROM lineitem GROUP BY l_suppkey, l_discount""",
)
def _d18(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_discount").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("t", t_critical(F.col("n") - 1))


@query(
    "d19_clipped_values",
    "SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE greatest(0.0, least(1.0, value / 50)) END AS unit, greatest(-1.0, least(1.0, value / 50 - 2)) AS signed FROM events",
)
def _d19(spark, sf):
    v = F.col("value") / 50
    return table(spark, sf, "events").select("event_id", clip(v, 0.0, 1.0).alias("unit"), clip(v - 2, -1.0, 1.0).alias("signed"))


@query(
    "d20_stage_durations",
    f"""WITH s AS (SELECT user_id, event_type, min(ts) AS created, CASE WHEN count(*) > 30 THEN max(ts) END AS completed FROM events GROUP BY ALL)
    SELECT user_id, event_type, {r("(epoch_us(completed) - epoch_us(created))::DOUBLE / 1e6", 3)} AS seconds,
    row_number() OVER (PARTITION BY user_id ORDER BY coalesce(completed, created) DESC, event_type) AS recency FROM s""",
)
def _d20(spark, sf):
    from pyspark.sql import Window

    stages = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.min("ts").alias("created"), F.when(F.count(F.lit(1)) > 30, F.max("ts")).alias("completed")
    )
    seconds = (F.unix_micros(F.col("completed").cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))) / F.lit(1e6)
    order = Window.partitionBy("user_id").orderBy(F.coalesce("completed", "created").desc(), "event_type")
    return stages.select(
        "user_id", "event_type", rounded(seconds, 3).alias("seconds"), F.row_number().over(order).alias("recency")
    )


@query(
    "d21_json_columns",
    """WITH raw AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{broken' ELSE props END AS props FROM events)
    SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
    CASE WHEN json_valid(props) THEN len(json_keys(props)) ELSE 0 END AS n_keys FROM raw""",
)
def _d21(spark, sf):
    broken = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    rows = table(spark, sf, "events").select("event_id", json_map(broken).alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("k")).cast("bigint").alias("k"), F.size("m").alias("n_keys"))


def json_map(c):
    """A JSON object as a map; anything else is an empty map."""
    parsed = F.when(F.get_json_object(c, "$").isNotNull(), F.from_json(c, "map<string,string>"))
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


@query(
    "d22_softmax",
    "WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, list_transform(embedding, lambda x: 10 * CAST(x AS DOUBLE)) AS z FROM embeddings), "
    "p AS (SELECT vec_id, i, exp(z[i + 1] - list_max(z)) AS w FROM e) "
    f"SELECT vec_id, i AS class, {r('w / sum(w) OVER (PARTITION BY vec_id)', 6)} AS p FROM p",
)
def _d22(spark, sf):
    z = F.transform("embedding", lambda v: v.cast("double") * 10)
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(softmax(z)).alias("class", "p"))
    return rows.select("vec_id", F.col("class").cast("bigint").alias("class"), rounded(F.col("p"), 6).alias("p"))


@query(
    "d23_pooled_vectors",
    f"""WITH t AS (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS dim FROM embeddings),
    m AS (SELECT label, dim, {r("avg(CAST(v AS DOUBLE))", 6)} AS mean FROM t WHERE vec_id % 3 <> 0 GROUP BY ALL),
    f AS (SELECT label, dim, CAST(v AS DOUBLE) AS first FROM t WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))
    SELECT label, dim, mean, {r("first", 6)} AS first FROM m JOIN f USING (label, dim)""",
)
def _d23(spark, sf):
    tokens = table(spark, sf, "embeddings").select(
        "label",
        "vec_id",
        F.col("embedding").cast("array<double>").alias("v"),
        (F.col("vec_id") % 3 != 0).alias("keep"),
    )
    mean = pooled_vectors(tokens, "label", "v", mask="keep")
    first = pooled_vectors(tokens, "label", "v", first="vec_id")
    both = mean.withColumnRenamed("vector", "m").join(first, "label")
    cells = both.select("label", F.posexplode(F.arrays_zip("m", "vector")).alias("dim", "c"))
    return cells.select(
        "label",
        F.col("dim").cast("bigint").alias("dim"),
        rounded(F.col("c.m"), 6).alias("mean"),
        rounded(F.col("c.vector"), 6).alias("first"),
    )


# --- sorts and limits ---------------------------------------------------------------------------------------------------------


def sort_order(column: str, ascending: bool = True, numeric: bool = False, row_idx: str = "row_idx"):
    """Result order: by text form (or as numbers), missing last, ties by row."""
    key = to_number(F.col(column)) if numeric else F.col(column).cast("string")
    return [key.asc_nulls_last() if ascending else key.desc_nulls_last(), F.col(row_idx)]


@query(
    "m1_text_sort",
    """SELECT row_idx, sentiment_conf, row_number() OVER (ORDER BY CAST(sentiment_conf AS VARCHAR) DESC NULLS LAST, row_idx) AS position FROM results""",
)
def _m1(spark, sf):
    from surveyloom.operators.ranks import positions

    rows = results(spark, sf).select("row_idx", "sentiment_conf")
    return positions(rows, sort_order("sentiment_conf", ascending=False), "position")


@query(
    "m2_catalog_list",
    """WITH c AS (SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%'),
    t AS (SELECT count(*) AS total FROM c) SELECT o_orderkey, o_totalprice, total FROM c, t ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""",
)
def _m2(spark, sf):
    from surveyloom.operators.common import with_scalars

    tags = F.array("o_orderstatus", F.element_at(F.split("o_orderpriority", "-"), 2))
    listed = table(spark, sf, "orders").withColumn("tags", tags)
    rows, total = catalog_list(
        listed,
        search_columns=["o_orderpriority"],
        search=None,
        any_tags=["URGENT", "HIGH"],
        sort="o_totalprice",
        descending=True,
        allowed=["o_totalprice", "o_orderdate"],
        key="o_orderkey",
        offset=50,
        limit=25,
    )
    return with_scalars(rows.select("o_orderkey", "o_totalprice"), total)


def catalog_list(df, search_columns, search, any_tags, sort, descending, allowed, key, offset, limit):
    """A catalog page and its exact total: substring search, tag containment, a sort column from a fixed list."""
    if search:
        hit = F.lit(False)
        for c in search_columns:
            hit = hit | F.lower(blank_to_empty(F.col(c))).contains(search.lower())
        df = df.where(hit)
    if any_tags:
        df = df.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in any_tags])))
    column = F.col(sort if sort in allowed else allowed[0])
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return df.orderBy(order, key).offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


@query(
    "m3_top_levels",
    "SELECT l_suppkey AS level, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, level LIMIT 25",
)
def _m3(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("level")).limit(25)


@query(
    "m4_capped_report",
    "WITH h AS (SELECT event_id, value FROM events WHERE value > 100) SELECT event_id, value, (SELECT count(*) FROM h) AS total FROM h ORDER BY event_id LIMIT 500",
)
def _m4(spark, sf):
    from surveyloom.operators.common import with_scalars

    rows, total = P.capped(table(spark, sf, "events").where("value > 100").select("event_id", "value"), "event_id", 500)
    return with_scalars(rows, total)
