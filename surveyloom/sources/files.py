"""File scans and sinks: typed survey CSV, all-string CSV, partitioned parquet, filtered exports, paged previews."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.numbers import blank_to_empty
from surveyloom.operators.schema import missing_columns, normalize_headers
from surveyloom.sources.tables import ITEMS, SURVEY_COLUMNS

# The texts a CSV reader takes for missing when the default null policy is on.
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_CSV = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "emptyValue": "",
    "nullValue": "\u0000",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_strings(spark: SparkSession, path: str, keep_default_na: bool = True) -> DataFrame:
    """Every column as text. With the default policy the usual missing markers become null, otherwise none does."""
    frame = spark.read.options(**_CSV).csv(path)
    frame = frame.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in frame.columns])
    return nulls_from_markers(frame) if keep_default_na else frame


def nulls_from_markers(frame: DataFrame) -> DataFrame:
    return frame.select(
        [F.when(~F.col(f"`{c}`").isin(NULL_TEXTS), F.col(f"`{c}`")).alias(c) for c in frame.columns]
    )


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """Typed survey scan: known columns only, items and ids coerced to integers, missing text becomes empty."""
    return type_survey(normalize_headers(read_strings(spark, path)))


def type_survey(frame: DataFrame) -> DataFrame:
    def typed(name: str) -> Column:
        c = F.col(name)
        if name == "survey_id":
            return F.trim(c).try_cast("double").try_cast("bigint").alias(name)
        if name in ITEMS:
            return F.trim(c).try_cast("double").try_cast("int").alias(name)
        if name == "text_feedback":
            return F.coalesce(c, F.lit("")).alias(name)
        return c

    return frame.select([typed(c) for c in SURVEY_COLUMNS if c in frame.columns])


def write_strings(frame: DataFrame, path: str) -> None:
    """CSV with quoted texts, line breaks and quotes kept."""
    frame.select([F.col(f"`{c}`").cast("string").alias(c) for c in frame.columns]).write.options(
        header="true", quote='"', escape='"', quoteAll="true", encoding="UTF-8", emptyValue="", nullValue=""
    ).csv(path)


# The allowed values of the questionnaire's labels and the range of its items.
DOMAINS = {
    "language": ["ru", "kz", "mixed"],
    "detail_level": ["short", "medium", "long"],
    "sentiment_class": ["positive", "neutral", "negative"],
}
ITEM_RANGE = (0, 10)


def validate_survey(
    frame: DataFrame,
    strict: bool = False,
    domains: dict[str, list[str]] = DOMAINS,
    item_range: tuple[int, int] = ITEM_RANGE,
) -> DataFrame:
    """(column, rule, n_bad) for missing columns, items out of range and unexpected labels, counted in one pass."""
    checks = []
    for c in SURVEY_COLUMNS:
        if c not in frame.columns:
            checks.append((c, "missing", F.lit(1).cast("bigint")))
        elif c in ITEMS:
            checks.append((c, "range", F.count_if(~F.col(c).between(*item_range))))
        elif c in domains:
            checks.append((c, "domain", F.count_if(~F.col(c).isin(domains[c]))))
    counts = frame.agg(F.count(F.lit(1)).alias("_rows"), *[n.alias(f"_{i}") for i, (_, _, n) in enumerate(checks)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.col(f"_{i}").alias("n_bad"))
        for i, (c, rule, _) in enumerate(checks)
    ]
    out = counts.select(F.inline(F.array(*rows)))
    if strict:
        bad = out.where(F.col("n_bad") > 0).collect()
        if bad:
            raise ValueError("; ".join(f"{r['column']}: {r['rule']} ({r['n_bad']})" for r in bad))
    return out


class TableCheckError(ValueError):
    """A structural fault that makes a table unusable."""


def check_structure(frame: DataFrame) -> DataFrame:
    """Reject fewer than two columns, repeated headers and empty tables; count the rows without any value."""
    problems = []
    if len(frame.columns) < 2:
        problems.append(f"only {len(frame.columns)} column(s)")
    repeated = sorted({c for c in frame.columns if frame.columns.count(c) > 1})
    if repeated:
        problems.append(f"repeated headers: {repeated}")
    if not problems and frame.isEmpty():
        problems.append("no rows")
    if problems:
        raise TableCheckError("; ".join(problems))
    return structure_counts(frame)


def structure_counts(frame: DataFrame) -> DataFrame:
    nothing = F.lit(True)
    for c in frame.columns:
        nothing = nothing & F.col(f"`{c}`").isNull()
    return frame.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(frame.columns)).cast("bigint").alias("n_columns"),
        F.count_if(nothing).alias("n_empty_rows"),
    )


#: Name of the column that holds the raw record of an unreadable line.
BAD_RECORD = "_bad_record"


def read_marked(spark: SparkSession, path: str, columns: list[str], header: bool = True, keep_default_na: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV rows with every column as text, and ``BAD_RECORD``: the record itself where it has more or fewer fields than ``columns``, else null.

    A bad record keeps the fields it has. With ``multi_line=False`` no quoted text may hold a line break, and a file is split over tasks; with it a file is one task.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, BAD_RECORD]])
    own = {"header": str(header).lower(), "multiLine": str(multi_line).lower(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD, "columnPruning": "false"}
    frame = spark.read.schema(schema).options(**{**_CSV, **own}).csv(path)
    cells = [F.col(f"`{c}`") for c in columns]
    if keep_default_na:
        cells = [F.when(~c.isin(NULL_TEXTS), c) for c in cells]
    return frame.select(*[c.alias(name) for c, name in zip(cells, columns, strict=True)], BAD_RECORD)


def write_checked(
    frame: DataFrame,
    path: str,
    required: list[str] = SURVEY_COLUMNS,
    domains: dict[str, list[str]] = DOMAINS,
    item_range: tuple[int, int] = ITEM_RANGE,
) -> DataFrame:
    """Write the good rows of a table as parquet; return (column, rule, n_bad), counted by the pass that writes.

    Rules: ``missing`` for each required column that is not there (1), ``range`` and ``domain`` by the values of good rows, and for the table (column null) ``rows`` written,
    ``empty`` rows without any value, and ``malformed`` records, which are not written. A frame without ``BAD_RECORD`` has none. Nothing is shuffled after the
    counts, so a task that runs again after a lost executor is counted once. Items must be numbers; text in an item's column breaks its range.
    """
    columns = [c for c in frame.columns if c != BAD_RECORD]
    bad = F.col(BAD_RECORD).isNotNull() if BAD_RECORD in frame.columns else F.lit(False)
    nothing = ~bad
    for c in columns:
        nothing = nothing & F.col(f"`{c}`").isNull()
    tests: list[tuple[str | None, str, Column]] = [(None, "rows", ~bad), (None, "empty", nothing), (None, "malformed", bad)]
    for c in required:
        if c not in columns:
            continue
        if c in ITEMS:
            number = F.col(c).try_cast("double")
            tests.append((c, "range", ~bad & F.col(c).isNotNull() & ~F.coalesce(number.between(*item_range), F.lit(False))))
        elif c in domains:
            tests.append((c, "domain", ~bad & ~F.col(c).isin(domains[c])))
    seen = Observation(f"checks-{uuid.uuid4().hex}")
    observed = frame.observe(seen, *[F.count_if(test).alias(f"n{i}") for i, (_, _, test) in enumerate(tests)])
    observed.where(~bad).select(*[F.col(f"`{c}`") for c in columns]).write.parquet(path)
    rows = [(c, rule, seen.get[f"n{i}"]) for i, (c, rule, _) in enumerate(tests)]
    rows += [(c, "missing", 1) for c in missing_columns(frame, required)]
    return frame.sparkSession.createDataFrame(rows, "column string, rule string, n_bad bigint")


def check_csv_header(spark: SparkSession, path: str) -> list[str]:
    """Header names as written; Spark renames repeated ones when it reads the table."""
    lines = spark.read.options(**{**_CSV, "header": "false"}).csv(path).limit(1).collect()
    if not lines:
        raise TableCheckError("no rows")
    names = [str(v) for v in lines[0] if v is not None]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if len(names) < 2 or repeated:
        raise TableCheckError(f"only {len(names)} column(s)" if len(names) < 2 else f"repeated headers: {repeated}")
    return names


def empty_table(spark: SparkSession, columns: list[str]) -> DataFrame:
    """A table without rows, every column a string."""
    if len(columns) < 2:
        raise ValueError("a table needs at least two columns")
    if len(set(columns)) != len(columns):
        raise ValueError("column names must differ")
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def write_partitioned(frame: DataFrame, path: str, by: str) -> None:
    frame.write.partitionBy(by).parquet(path)


def write_export(frame: DataFrame, path: str, fmt: str) -> None:
    """CSV for spreadsheets (byte order mark in the first header of each file) or JSON lines."""
    if fmt == "json":
        frame.write.option("ignoreNullFields", "false").json(path)
        return
    if fmt != "csv":
        raise ValueError(f"unknown export format {fmt!r}")
    first, *rest = frame.columns
    write_strings(frame.withColumnRenamed(first, f"﻿{first}").select(f"﻿{first}", *rest), path)


def read_export(spark: SparkSession, path: str, fmt: str, columns: list[str]) -> DataFrame:
    if fmt == "json":
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        return spark.read.schema(schema).json(path)
    frame = read_strings(spark, path, keep_default_na=False)
    return frame.toDF(*[c.replace("﻿", "") for c in frame.columns]).select(columns)


def page(frame: DataFrame, offset: int, limit: int, row_idx: str = "row_idx") -> DataFrame:
    """Rows offset .. offset+limit-1 of a densely numbered table: a range filter the scan can prune by.

    Every value is text, missing ones are empty. Callers take the total from a separate count.
    """
    chosen = frame.where(F.col(row_idx).between(offset, offset + limit - 1))
    return chosen.select(
        row_idx, *[blank_to_empty(F.col(f"`{c}`")).alias(c) for c in frame.columns if c != row_idx]
    )


def page_by_order(frame: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a sorted view that has no row numbers; cost grows with offset + limit, not with the table."""
    return frame.orderBy(*order).offset(offset).limit(limit)
