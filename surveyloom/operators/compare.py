"""Comparison of scoring runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numbers import rounded
from surveyloom.operators.align import two_runs
from surveyloom.operators.profile import shares


def shared_tasks(first: DataFrame, second: DataFrame, task: str = "task") -> DataFrame:
    return first.select(task).intersect(second.select(task))


def class_union(*frames: DataFrame, column: str = "label") -> DataFrame:
    out = frames[0].select(column)
    for f in frames[1:]:
        out = out.union(f.select(column))
    return out.distinct()


def distribution_deltas(first: DataFrame, second: DataFrame, pred: str) -> DataFrame:
    """Change of every class's share from the first run to the second, over all classes of both."""
    a = shares(first, pred).select("label", F.col("share").alias("share_1"))
    b = shares(second, pred).select("label", F.col("share").alias("share_2"))
    joined = a.join(b, "label", "full_outer").fillna(0.0)
    return joined.withColumn("delta", rounded(F.col("share_2") - F.col("share_1")))


def disagreement(first: DataFrame, second: DataFrame, tasks: dict[str, str], row_idx: str = "row_idx") -> DataFrame:
    """Share of common rows on which two runs differ, per task and on average over the tasks."""
    parts = []
    for task, pred in tasks.items():
        rows = two_runs(first, second, pred, row_idx)
        differs = F.coalesce("pred_1", F.lit("")) != F.coalesce("pred_2", F.lit(""))
        parts.append(rows.agg(rounded(F.avg(differs.cast("double"))).alias("rate")).select(F.lit(task).alias("task"), "rate"))
    by_task = parts[0]
    for p in parts[1:]:
        by_task = by_task.unionByName(p)
    overall = by_task.agg(rounded(F.avg("rate")).alias("rate")).select(F.lit("overall").alias("task"), "rate")
    return by_task.unionByName(overall)
