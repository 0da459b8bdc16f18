"""Classification and regression metrics, calibration and residual reports, all derived from grouped counts and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.numbers import clip, not_nan, number, rounded, safe_ratio, to_number
from surveyloom.functions.text import is_blank
from surveyloom.operators.predicates import short_text
from surveyloom.operators.ranks import exact_quantiles


def pair_counts(df: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """(by, y_true, y_pred, n): the only pass over the rows; what follows has one row per pair of classes."""
    return df.groupBy(*(by or []), F.col(y).alias("y_true"), F.col(yhat).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def non_blank_pairs(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.where(~is_blank(F.col(y)) & ~is_blank(F.col(yhat)))


def confusion_matrix(df: DataFrame, y: str, yhat: str, labels: list[str] | None = None) -> DataFrame:
    """Every pair of labels with its count, zeros included."""
    counts = pair_counts(df, y, yhat)
    if labels:
        found = df.sparkSession.createDataFrame([(labels,)], "labels array<string>")
    else:
        both = F.explode(F.array("y_true", "y_pred"))
        found = counts.select(both.alias("label")).agg(F.collect_set("label").alias("labels"))
    grid = found.select("labels", F.explode("labels").alias("y_true")).select("y_true", F.explode("labels").alias("y_pred"))
    return grid.join(counts, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(counts: DataFrame, by: list[str] | None = None, classes: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class from pair counts, unrounded, with the sums behind them."""
    by = by or []
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("truth"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("truth"), F.col("n").alias("said")),
    )
    hit = F.when((F.col("y_true") == F.col("y_pred")) & (F.col("truth") > 0), F.col("n")).otherwise(0)
    sums = (
        counts.select(*by, "y_true", "y_pred", "n", F.inline(sides))
        .groupBy(*by, "label")
        .agg(F.sum("truth").alias("support"), F.sum("said").alias("predicted"), F.sum(hit).alias("tp"))
    )
    if classes:
        sums = sums.where(F.col("label").isin(classes))
    return sums.withColumns(
        {
            "precision": safe_ratio(F.col("tp"), F.col("predicted")),
            "recall": safe_ratio(F.col("tp"), F.col("support")),
            "f1": safe_ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
        }
    )


def classification_metrics(
    df: DataFrame,
    y: str,
    yhat: str,
    by: list[str] | None = None,
    classes: list[str] | None = None,
    min_rows: int = 0,
    digits: int = 6,
) -> DataFrame:
    """One row per (stratum and) class with its metrics and the accuracy and macro F1 of the whole (stratum)."""
    by = by or []
    counts = pair_counts(df, y, yhat, by)
    for stratum in by:
        counts = counts.where(F.col(stratum).isNotNull())
    labels = per_class(counts, by, classes)
    overall = counts.groupBy(*by).agg(
        F.sum("n").alias("n_samples"),
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("_right"),
    )
    macro = Window.partitionBy(*(by or [F.lit(1)]))
    scored = labels.withColumn("macro_f1", F.avg("f1").over(macro)).withColumn("_key", F.lit(1))
    joined = scored.join(F.broadcast(overall.withColumn("_key", F.lit(1))), ["_key", *by])
    return joined.where(F.col("n_samples") >= min_rows).select(
        *by,
        "label",
        "support",
        rounded(F.col("precision"), digits).alias("precision"),
        rounded(F.col("recall"), digits).alias("recall"),
        rounded(F.col("f1"), digits).alias("f1"),
        rounded(safe_ratio(F.col("_right"), F.col("n_samples")), digits).alias("accuracy"),
        rounded(F.col("macro_f1"), digits).alias("macro_f1"),
        "n_samples",
    )


def classification_diagnostics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Metrics over the rows whose truth and prediction are both non-blank, four decimals."""
    return classification_metrics(non_blank_pairs(df, y, yhat), y, yhat, digits=4)


def calibration_bins(df: DataFrame, y: str, yhat: str, conf: str, bins: int = 10) -> DataFrame:
    """Equal-width confidence bins, closed on the right, with count, mean confidence and accuracy, and the overall ECE."""
    rows = non_blank_pairs(df, y, yhat).select(
        clip(to_number(F.col(conf)), 0.0, 1.0).alias("c"), (F.col(y) == F.col(yhat)).cast("double").alias("hit")
    )
    number = F.greatest(F.lit(1), F.ceil(F.col("c") * bins)).cast("int")
    grouped = (
        rows.where(F.col("c").isNotNull())
        .groupBy(number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"), F.avg("c").alias("_conf"), F.avg("hit").alias("_acc"))
    )
    whole = Window.partitionBy(F.lit(1))
    error = F.sum(F.col("count") * F.abs(F.col("_acc") - F.col("_conf"))).over(whole) / F.sum("count").over(whole)
    return grouped.select(
        "bin",
        ((F.col("bin") - 1) / F.lit(float(bins))).alias("low"),
        (F.col("bin") / F.lit(float(bins))).alias("high"),
        "count",
        rounded(F.col("_conf")).alias("avg_confidence"),
        rounded(F.col("_acc")).alias("accuracy"),
        rounded(error).alias("ece"),
    )


def regression_metrics(
    df: DataFrame, targets: dict[str, tuple[str, str]], by: list[str] | None = None, min_rows: int = 0, digits: int = 6
) -> DataFrame:
    """MAE and R2 per target and their uniform averages, for each stratum in one pass.

    ``targets`` maps a target name to its (truth, prediction) columns.
    """
    by = by or []
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("target"),
                not_nan(F.col(y).cast("double")).alias("y"),
                not_nan(F.col(p).cast("double")).alias("p"),
            )
            for name, (y, p) in targets.items()
        ]
    )
    rows = df.select(*by, F.inline(cells)).where(F.col("y").isNotNull() & F.col("p").isNotNull())
    for stratum in by:
        rows = rows.where(F.col(stratum).isNotNull())
    sums = rows.groupBy(*by, "target").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("y") - F.col("p"))).alias("_mae"),
        F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("_sse"),
        F.var_pop("y").alias("_var"),
    )
    constant = F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("_var") > 0, 1.0 - F.col("_sse") / (F.col("_var") * F.col("n"))).otherwise(constant)
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    return (
        sums.withColumn("_r2", r2)
        .withColumns({"_mae_all": F.avg("_mae").over(whole), "_r2_all": F.avg("_r2").over(whole)})
        .where(F.col("n") >= min_rows)
        .select(
            *by,
            "target",
            "n",
            rounded(F.col("_mae"), digits).alias("mae"),
            rounded(F.col("_r2"), digits).alias("r2"),
            rounded(F.col("_mae_all"), digits).alias("mae_overall"),
            rounded(F.col("_r2_all"), digits).alias("r2_overall"),
        )
    )


def residual_rows(df: DataFrame, y: str, yhat: str) -> DataFrame:
    pairs = df.select(number(df, y).alias("y"), number(df, yhat).alias("fitted"), F.lit("all").alias("_key"))
    return pairs.dropna().withColumn("residual", F.col("y") - F.col("fitted"))


def residual_summary(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Location and spread of the residuals and their growth with the fitted value."""
    rows = residual_rows(df, y, yhat)
    r = F.col("residual")
    stats = rows.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(r).alias("mean"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std"),
        F.avg(F.abs(r)).alias("mae"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
        F.min(r).alias("min"),
        F.max(r).alias("max"),
        F.coalesce(F.corr("fitted", F.abs(r)), F.lit(0.0)).alias("abs_residual_fitted_correlation"),
    )
    median = exact_quantiles(rows, ["_key"], r, [0.5])
    names = ["mean", "std", "mae", "rmse", "min", "max", "abs_residual_fitted_correlation"]
    return stats.join(F.broadcast(median), "_key").select(
        "n_rows", *[rounded(F.col(n)).alias(n) for n in names], rounded(F.col("q0")).alias("median")
    )


def residual_bins(df: DataFrame, y: str, yhat: str, bins: int = 10) -> DataFrame:
    """Residuals by quantile bins of the fitted value: closed on the right, repeated edges merged, exact edges."""
    rows = residual_rows(df, y, yhat)
    levels = rows.select("fitted").distinct().limit(bins).count()
    used = min(max(1, bins), max(1, levels))
    q = exact_quantiles(rows, ["_key"], F.col("fitted"), [i / used for i in range(used + 1)])
    edges = q.select("_key", F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(used + 1)])).alias("edges"))
    inner = F.slice("edges", 2, F.size("edges") - 2)
    number = F.when(F.size("edges") > 2, F.size(F.filter(inner, lambda e: e < F.col("fitted")))).otherwise(0)
    placed = rows.join(F.broadcast(edges), "_key").where(F.size("edges") > 1).withColumn("bin", number + 1)
    return placed.groupBy("bin").agg(
        rounded(F.first(F.col("edges")[F.col("bin") - 1])).alias("low"),
        rounded(F.first(F.col("edges")[F.col("bin")])).alias("high"),
        F.count(F.lit(1)).alias("count"),
        rounded(F.avg("fitted")).alias("mean_fitted"),
        rounded(F.avg("residual")).alias("mean_residual"),
        rounded(F.coalesce(F.stddev_samp("residual"), F.lit(0.0))).alias("std_residual"),
    )


def sensitivity(df: DataFrame, y: str, yhat: str, text: str, groups: list[str], short: int = 20) -> DataFrame:
    """Accuracy and macro F1 within every level of the group columns and on short and blank texts, in one pass.

    Slices overlap, so each row is repeated once per slice it is in; slices with one row are left out.
    """
    slices = [
        *[F.struct(F.lit(g).alias("slice"), F.col(g).alias("level")) for g in groups],
        F.when(short_text(F.col(text), short), F.struct(F.lit("text").alias("slice"), F.lit("short").alias("level"))),
        F.when(is_blank(F.col(text)), F.struct(F.lit("text").alias("slice"), F.lit("empty").alias("level"))),
    ]
    rows = df.select(y, yhat, F.inline(F.array_compact(F.array(*slices)))).where(F.col("level").isNotNull())
    metrics = classification_metrics(rows, y, yhat, by=["slice", "level"], min_rows=2)
    return metrics.select("slice", "level", "macro_f1", "accuracy", "n_samples").distinct()
