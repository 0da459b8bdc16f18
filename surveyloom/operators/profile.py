"""Descriptive statistics: numeric, categorical and text summaries, distributions, segments, profiles, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.intervals import t_bounds, wilson
from surveyloom.functions.numbers import LONG_LEVEL, blank_to_empty, level_key, number, rounded, safe_ratio, to_number
from surveyloom.functions.text import is_blank, word_count
from surveyloom.operators.ranks import exact_quantiles, top_per_group
from surveyloom.operators.resample import Moments, bootstrap_metric
from surveyloom.session import settle

QUARTILES = [0.25, 0.5, 0.75]


def long_text(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """One row per cell: (ids, column, value as text). All columns go through one pass and one shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(*(ids or []), F.inline(cells))


def long_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per cell: (column, value: empty text or null, num). Only text columns are parsed."""
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(F.col(f"`{c}`").isNotNull(), F.lit("")).alias("value"),
            number(df, c).alias("num"),
        )
        for c in columns
    ]
    return df.select(F.inline(F.array(*cells)))


def column_profile(df: DataFrame, row_idx: str, columns: list[str] | None = None, samples: int = 5) -> DataFrame:
    """Type, distinct non-null values, nulls, and the first values by row, for every column."""
    columns = columns or [c for c in df.columns if c != row_idx]
    kinds = dict(df.dtypes)
    cells = long_text(df, columns, [row_idx])
    levels = cells.groupBy("column", level_key(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = levels.groupBy("column").agg(
        F.count("value").alias("n_unique"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    )
    first = top_per_group(cells.where(F.col("value").isNotNull()), ["column"], [F.col(row_idx)], samples)
    sampled = first.groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values")
    )
    dtype = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    return counts.join(sampled, "column", "left").select(
        "column",
        F.try_element_at(dtype, F.col("column")).alias("dtype"),
        "n_unique",
        "n_null",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def summarize_long(cells: DataFrame, keys: list[str], few_keys: bool = True) -> DataFrame:
    """Numeric summary of (keys, raw text, num) rows; four decimals; zeros where nothing is numeric."""
    stats = cells.groupBy(*keys).agg(
        F.count("num").alias("count"),
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("value").isNull()).alias("_nulls"),
        F.avg("num").alias("_mean"),
        F.stddev_samp("num").alias("_std"),
        F.min("num").alias("_min"),
        F.max("num").alias("_max"),
    )
    quantiles = exact_quantiles(cells, keys, F.col("num"), QUARTILES, few_keys)
    joined = stats.join(F.broadcast(quantiles) if few_keys else quantiles, keys, "left")
    mean = F.coalesce("_mean", F.lit(0.0))
    std = F.when(F.col("count") > 1, F.col("_std")).otherwise(0.0)
    low, high = t_bounds(mean, std, F.col("count"))

    def shown(c: Column) -> Column:
        return rounded(F.coalesce(c, F.lit(0.0)))

    return joined.select(
        *keys,
        "count",
        F.when(F.col("count") == 0, F.col("_nulls")).otherwise(F.col("_rows") - F.col("count")).alias("missing"),
        shown(mean).alias("mean"),
        shown(std).alias("std"),
        shown(F.col("_min")).alias("min"),
        shown(F.col("q0")).alias("q25"),
        shown(F.col("q1")).alias("median"),
        shown(F.col("q2")).alias("q75"),
        shown(F.col("_max")).alias("max"),
        low.alias("ci_low"),
        high.alias("ci_high"),
    )


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, missing, mean, std, five numbers and the t interval for every column."""
    return summarize_long(long_numbers(df, columns), ["column"])


def mean_interval(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and its t interval for every column."""
    stats = long_numbers(df, columns).groupBy("column").agg(
        F.count("num").alias("n"), F.avg("num").alias("_mean"), F.stddev_samp("num").alias("_std")
    )
    mean = F.coalesce("_mean", F.lit(0.0))
    low, high = t_bounds(mean, F.coalesce("_std", F.lit(0.0)), F.col("n"))
    return stats.select("column", "n", rounded(mean).alias("estimate"), low.alias("low"), high.alias("high"))


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, level, head, n) with blank values merged into null; long texts are counted by digest, ``head`` is how each level begins."""
    return (
        _filled(df, columns)
        .groupBy("column", level_key(F.col("value")).alias("level"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.substring("value", 1, LONG_LEVEL)).alias("head"))
    )


def _filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_text(df, columns).withColumn("value", F.when(~is_blank(F.col("value")), F.col("value")))


def _top_levels(df: DataFrame, columns: list[str], counts: DataFrame, k: int) -> DataFrame:
    """(column, rank, value, n): the k most frequent levels of every column, ties by level.

    Levels are chosen by count and beginning, all that tie there included. Only where long texts are among them are the rows read again, for the texts
    of these alone; equal texts are merged in each task before they move.
    """
    place = F.rank().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc("head")))
    chosen = settle(counts.where(F.col("level").isNotNull()).withColumn("_place", place).where(F.col("_place") <= k).drop("_place"), "levels")
    long = chosen.where(F.length("level") > LONG_LEVEL).select("column", "level")
    value = F.col("level")
    if not long.isEmpty():
        cells = _filled(df, columns).where(F.length("value") > LONG_LEVEL).withColumn("level", level_key(F.col("value")))
        texts = cells.join(long, ["column", "level"], "left_semi").groupBy("column", "level").agg(F.first("value").alias("text"))
        chosen, value = chosen.join(texts, ["column", "level"], "left"), F.coalesce("text", "level")
    return top_per_group(chosen.select("column", value.alias("value"), "n"), ["column"], [F.desc("n"), F.asc("value")], k)


def categorical_frequency(df: DataFrame, columns: list[str], max_levels: int = 25) -> DataFrame:
    """Most frequent levels of every column with proportion and Wilson interval; ties go by level."""
    counts = settle(level_counts(df, columns), "counts")
    totals = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("level").isNotNull(), F.col("n"))), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("level").alias("n_unique"),
    )
    top = _top_levels(df, columns, counts, max_levels)
    low, high = wilson(F.col("n"), F.col("count"))
    return (
        totals.join(top, "column", "left")
        .select(
            "column",
            "count",
            "missing",
            "n_unique",
            "rank",
            F.col("value").alias("level"),
            F.col("n").alias("level_count"),
            rounded(safe_ratio(F.col("n"), F.col("count"))).alias("proportion"),
            low.alias("ci_low"),
            high.alias("ci_high"),
        )
    )


def text_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, measure, value, num) rows: character and word length of every non-blank text."""
    cells = long_text(df, columns).where(~is_blank(F.col("value")))
    measures = F.array(
        F.struct(F.lit("char_length").alias("measure"), F.length("value").cast("double").alias("num")),
        F.struct(F.lit("word_length").alias("measure"), word_count(F.col("value")).cast("double").alias("num")),
    )
    return cells.select("column", F.lit("").alias("value"), F.inline(measures))


def text_length_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric summary of character and word length per text column."""
    return summarize_long(text_cells(df, columns), ["column", "measure"])


def numeric_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose non-blank values all parse as numbers; one aggregate for the table, one row to the driver."""
    bad = [
        F.count_if(~is_blank(F.col(f"`{c}`")) & to_number(F.col(f"`{c}`")).isNull()).alias(f"_{i}")
        for i, c in enumerate(columns)
    ]
    row = df.agg(*bad).first()
    return [c for c, n in zip(columns, row, strict=True) if n == 0]


SUMMARY_METRICS = ["count", "missing", "mean", "std", "min", "q25", "median", "q75", "max", "ci_low", "ci_high"]


def as_metrics(df: DataFrame, section: str, column: Column, name: Column, metrics: list[str]) -> DataFrame:
    """Turn metric columns into (section, column, name, metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(section).alias("section"), column.alias("column"), name.alias("name"), F.inline(pairs))


def descriptive_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Summary of a whole table: numeric columns get the numeric summary, others levels and text lengths."""
    columns = columns or df.columns
    numeric = numeric_columns(df, columns)
    other = [c for c in columns if c not in numeric]
    parts = []
    if numeric:
        parts.append(as_metrics(numeric_summary(df, numeric), "numeric", F.col("column"), F.lit(""), SUMMARY_METRICS))
    if other:
        levels = categorical_frequency(df, other)
        parts.append(
            as_metrics(
                levels,
                "categorical",
                F.col("column"),
                F.col("level"),
                ["count", "missing", "n_unique", "level_count", "proportion", "ci_low", "ci_high"],
            )
        )
        lengths = text_length_stats(df, other)
        parts.append(as_metrics(lengths, "text", F.col("column"), F.col("measure"), SUMMARY_METRICS))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) for the columns that exist; a missing value counts as the empty text."""
    present = [c for c in columns if c in df.columns]
    cells = long_text(df, present)
    return cells.groupBy("column", blank_to_empty(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def segment_stats(df: DataFrame, group: str, metric: str, few_groups: bool = False) -> DataFrame:
    """count, mean, median and std of a coerced metric per group."""
    rows = df.select(F.col(group).cast("string").alias("group"), number(df, metric).alias("num")).where(
        F.col("num").isNotNull() & F.col("group").isNotNull()
    )
    stats = rows.groupBy("group").agg(
        F.count("num").alias("count"), F.avg("num").alias("_mean"), F.stddev_samp("num").alias("_std")
    )
    medians = exact_quantiles(rows, ["group"], F.col("num"), [0.5], few_groups)
    return stats.join(medians, "group").select(
        "group",
        "count",
        rounded(F.col("_mean")).alias("mean"),
        rounded(F.col("q0")).alias("median"),
        rounded(F.when(F.col("count") > 1, F.col("_std")).otherwise(0.0)).alias("std"),
    )


def shares(df: DataFrame, column: str, name: str = "label") -> DataFrame:
    """Share of every level among the non-null values. The grouped table is small: one row per level."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select(name, "n", rounded(F.col("n") / total).alias("share"))


def class_inflation(df: DataFrame, column: str, level: str = "neutral", threshold: float = 0.60) -> DataFrame:
    """Share of one predicted class and whether it dominates."""
    rate = F.avg(F.when(F.col(column) == level, 1.0).otherwise(0.0))
    return df.agg(F.count(F.lit(1)).alias("n"), rate.alias("_rate")).select(
        "n", rounded(F.col("_rate")).alias("rate"), (F.col("_rate") > threshold).alias("inflated")
    )


PROFILE_PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def training_profile(df: DataFrame, text: str, label: str, vocabulary: DataFrame) -> DataFrame:
    """Length quantiles, class priors and vocabulary size as (section, name, value) rows."""
    c = F.coalesce(F.col(text), F.lit(""))
    lengths = df.select(
        F.inline(
            F.array(
                F.struct(F.lit("text_length_chars").alias("section"), F.length(c).cast("double").alias("num")),
                F.struct(F.lit("text_length_words").alias("section"), word_count(c).cast("double").alias("num")),
            )
        )
    )
    q = exact_quantiles(lengths, ["section"], F.col("num"), list(PROFILE_PROBS.values()))
    pairs = F.array(
        *[F.struct(F.lit(p).alias("name"), rounded(F.col(f"q{i}"), 2).alias("value")) for i, p in enumerate(PROFILE_PROBS)]
    )
    priors = shares(df.withColumn(label, F.coalesce(F.col(label), F.lit(""))), label)
    return (
        q.select("section", F.inline(pairs))
        .unionByName(priors.select(F.lit("class_priors").alias("section"), F.col("label").alias("name"), F.col("share").alias("value")))
        .unionByName(
            vocabulary.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
                F.lit("vocabulary_size").alias("section"), F.lit("").alias("name"), "value"
            )
        )
    )


def bootstrap_interval(
    df: DataFrame,
    value: Column,
    metric: str | float = "mean",
    n_resamples: int = 1000,
    seed: int = 42,
    confidence: float = 0.95,
) -> DataFrame:
    """Percentile bootstrap interval of ``mean``, ``sum``, ``std``, or the quantile at a number between 0 and 1; see ``resample`` for metrics of one's own."""
    chosen = Moments(metric) if isinstance(metric, str) else metric
    return bootstrap_metric(df, value, chosen, n_resamples, seed, confidence)


def quartile_histogram(summary: DataFrame) -> DataFrame:
    """Four bars with a quarter of the rows each, from a numeric summary; one bar if all five numbers agree."""
    marks = F.array("min", "q25", "median", "q75", "max")
    n = F.col("count")
    quarter = rounded(n * 0.25, 0).cast("bigint")
    last = n - rounded(n * 0.75, 0).cast("bigint")

    def bar(i: int, size: Column) -> Column:
        return F.struct(
            F.lit(i + 1).alias("bin"), marks[i].alias("start"), marks[i + 1].alias("end"), size.alias("bin_count")
        )

    bars = F.array(bar(0, quarter), bar(1, quarter), bar(2, quarter), bar(3, last))
    single = F.array(F.struct(F.lit(1).alias("bin"), marks[0].alias("start"), marks[0].alias("end"), n.alias("bin_count")))
    shown = F.when(F.size(F.array_distinct(marks)) <= 1, single).otherwise(bars)
    keys = [c for c in summary.columns if c in ("column", "measure")]
    return summary.where(n > 0).select(*keys, F.inline(shown))


def top_sections(levels: DataFrame, max_columns: int = 4, max_levels: int = 8) -> DataFrame:
    """The columns with most values and, in each, the most frequent levels."""
    columns = levels.select("column", "count").distinct()
    chosen = columns.orderBy(F.desc("count"), F.asc("column")).limit(max_columns)
    ranked = top_per_group(levels.drop("rank"), ["column"], [F.desc("level_count"), F.asc("level")], max_levels)
    return ranked.join(F.broadcast(chosen.select("column")), "column", "left_semi").select(
        "column", "count", "rank", "level", "level_count"
    )


def owner_counts(owners: DataFrame, owned: DataFrame, key: str, foreign: str, name: str = "n") -> DataFrame:
    """Number of owned rows per owner, zero included. The owned side is merged before it is joined."""
    counts = owned.groupBy(F.col(foreign).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return owners.select(key).join(counts, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def run_status(stages: DataFrame, run: str, status: str) -> DataFrame:
    """Status of a run from its stages: any failed, all completed, any running, else pending."""
    flags = stages.groupBy(run).agg(
        F.bool_or(F.col(status) == "failed").alias("_failed"),
        F.bool_and(F.col(status) == "completed").alias("_done"),
        F.bool_or(F.col(status) == "running").alias("_running"),
    )
    return flags.select(
        run,
        F.when(F.col("_failed"), "failed")
        .when(F.col("_done"), "completed")
        .when(F.col("_running"), "running")
        .otherwise("pending")
        .alias("status"),
    )
