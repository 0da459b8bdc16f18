"""Declarative row filters compiled to one Column, so that they run inside the scan's stage."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.numbers import blank_to_empty, number
from surveyloom.functions.text import is_blank, strip

COMPARISONS = {
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
}


def _folded(name: str) -> Column:
    return F.lower(blank_to_empty(F.col(f"`{name}`")))


def rule_column(df: DataFrame, rule: Mapping[str, Any]) -> Column | None:
    """The condition of one {col, op, val} rule; None when the rule says nothing about this table."""
    name, op, value = str(rule.get("col", "")), rule.get("op", "eq"), rule.get("val", "")
    if not name or name not in df.columns:
        return None
    if op == "eq":
        return _folded(name) == str(value).lower()
    if op == "ne":
        return _folded(name) != str(value).lower()
    if op == "contains":
        return _folded(name).contains(str(value).lower())
    if op in COMPARISONS:
        try:
            wanted = float(value)
        except (TypeError, ValueError):
            return None
        if wanted != wanted:
            return F.lit(False)
        return F.coalesce(COMPARISONS[op](number(df, name), F.lit(wanted)), F.lit(False))
    return None


def rules_column(df: DataFrame, rules: Iterable[Mapping[str, Any]]) -> Column:
    """Conjunction of all rules that apply."""
    parts = [c for c in (rule_column(df, r) for r in rules) if c is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search_column(df: DataFrame, needle: str) -> Column:
    """Any string column contains the needle, letter case ignored."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    hits = [_folded(n).contains(needle.lower()) for n in names]
    return reduce(lambda a, b: a | b, hits, F.lit(False)) if names else F.lit(True)


def filter_rows(
    df: DataFrame,
    rules: Iterable[Mapping[str, Any]] | None = None,
    search: str | None = None,
    column: str | None = None,
    value: str | None = None,
) -> DataFrame:
    """Rules, or the single equality when there are none, and the full-text search."""
    rules = list(rules or [])
    if rules:
        df = df.where(rules_column(df, rules))
    elif column and value and column in df.columns:
        df = df.where(_folded(column) == value.lower())
    if search and search.strip():
        df = df.where(search_column(df, search))
    return df


def subset_column(df: DataFrame, config: Mapping[str, Mapping[str, Any]]) -> Column:
    """Exact equality, membership, or a case-insensitive regular expression on the text form; null never matches."""
    parts = []
    for name, value in config.get("column_equals", {}).items():
        if name in df.columns:
            parts.append(F.col(name).cast("string") == str(value))
    for name, values in config.get("column_in", {}).items():
        if name in df.columns:
            parts.append(F.col(name).cast("string").isin([str(v) for v in values]))
    for name, pattern in config.get("column_contains", {}).items():
        if name in df.columns:
            parts.append(F.col(name).cast("string").rlike(f"(?iu){pattern}"))
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def subset(df: DataFrame, config: Mapping[str, Any], row_idx: str = "row_idx", require_rows: bool = False) -> DataFrame:
    """Rows of a table by column conditions and, last, by positions among the rows that are left."""
    chosen = df.where(subset_column(df, config))
    if "row_indices" in config:
        from surveyloom.operators.ranks import dense_index

        wanted = df.sparkSession.createDataFrame([(int(i),) for i in set(config["row_indices"])], "_position bigint")
        numbered = dense_index(chosen, row_idx, name="_position")
        chosen = numbered.join(wanted, "_position", "left_semi").drop("_position")
    if require_rows and chosen.isEmpty():
        raise ValueError("the filter leaves no rows")
    return chosen


def anomalies(df: DataFrame, text_col: str, threshold: float = 0.6, suffix: str = "_conf") -> DataFrame:
    """Rows with a low confidence or a blank text, with the reasons."""
    reasons = []
    for name in [c for c in df.columns if c.endswith(suffix)]:
        conf = number(df, name)
        reasons.append(F.when(conf < threshold, F.format_string(f"low_confidence({name}=%.3f)", conf)))
    if text_col in df.columns:
        reasons.append(F.when(is_blank(F.col(text_col)), F.lit(f"empty_text({text_col})")))
    return df.withColumn("reasons", F.array_compact(F.array(*reasons))).where(F.size("reasons") > 0)


def capped(df: DataFrame, row_idx: str, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first rows of a report and, apart from them, the exact total."""
    return df.orderBy(row_idx).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


def short_text(c: Column, n: int = 20) -> Column:
    return F.length(F.coalesce(c, F.lit(""))) <= n


def trainable_rows(df: DataFrame, label: str, min_rows: int = 5, min_classes: int = 2, strict: bool = False) -> DataFrame:
    """Rows with a usable label: blank labels and classes with too few rows drop out, labels are stripped.

    The class table is one row per class, so the semi-join broadcasts only what its size allows.
    """
    labelled = df.where(~is_blank(F.col(label))).withColumn(label, strip(F.col(label).cast("string")))
    counts = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    if strict:
        sizes = [r["_n"] for r in counts.orderBy(F.desc("_n")).limit(min_classes).collect()]
        if len(sizes) < min_classes:
            raise ValueError(f"{label} needs at least {min_classes} classes")
        if sizes[-1] < min_rows:
            raise ValueError(f"{label} has fewer than {min_classes} classes with {min_rows} rows")
    return labelled.join(counts.where(F.col("_n") >= min_rows), label, "left_semi")


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def preset_counts(df: DataFrame, presets: Mapping[str, list[Mapping[str, Any]]]) -> DataFrame:
    """Rows each stored rule set keeps, all presets counted in one pass."""
    names = list(presets)
    counts = df.agg(*[F.count_if(rules_column(df, presets[n])).alias(f"_{i}") for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("preset"), F.col(f"_{i}").alias("n")) for i, n in enumerate(names)])
    return counts.select(F.inline(pairs))


def find_cells(df: DataFrame, needle: str, row_idx: str = "row_idx", column: str | None = None) -> DataFrame:
    """(row_idx, col) of every cell whose text contains the needle."""
    names = [c for c in df.columns if c != row_idx and (column is None or c == column)]
    cells = F.array(*[F.struct(F.lit(n).alias("col"), _folded(n).contains(needle.lower()).alias("hit")) for n in names])
    hits = F.filter(cells, lambda cell: cell["hit"])
    return df.select(row_idx, F.inline(hits)).select(row_idx, "col")
