"""Percentile bootstrap of any metric: an aggregator of the user's own, or an exact quantile.

Drawing ``n`` copies of a value with replacement is drawing Poisson(``n``) copies, so equal values are merged first and every replicate is a column of
weights beside the values. An aggregator keeps one state for all replicates; tasks' states, whose size does not depend on the rows, are merged in a
tree. The first column holds the true counts, so the estimate comes from the same pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions.numbers import rounded, to_number
from surveyloom.operators.ranks import value_counts
from surveyloom.session import settle

#: Distinct values whose weights are drawn in one go.
VALUES_PER_DRAW = 1024
#: States merged by one task of the tree.
FAN = 16
#: Ranges of values a quantile is first located in.
RANGES = 1024
# Chances that a Poisson variable of mean 1 is at most 0, 1, 2, ...
POISSON_ONE = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402]

Draws = Iterator[tuple[np.ndarray, np.ndarray]]


class Aggregator(Protocol):
    """A metric over weighted values, for many replicates at once. States are pickled; their size must not grow with the rows."""

    def init(self, n: int) -> Any:
        """The state of ``n`` replicates without rows."""

    def update(self, state: Any, values: np.ndarray, weights: np.ndarray) -> Any:
        """Add values; ``weights[i, r]`` is how often replicate ``r`` holds ``values[i]``."""

    def merge(self, left: Any, right: Any) -> Any:
        """Put two states over different rows together."""

    def finish(self, state: Any) -> np.ndarray:
        """One number per replicate, NaN where there is none."""


class Moments:
    """Mean, sum or sample standard deviation."""

    def __init__(self, kind: str):
        if kind not in ("mean", "sum", "std"):
            raise ValueError(f"unknown metric {kind!r}")
        self.kind = kind

    def init(self, n: int) -> np.ndarray:
        return np.zeros((3, n))

    def update(self, state: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return state + np.stack([weights.sum(axis=0), values @ weights, (values * values) @ weights])

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left + right

    def finish(self, state: np.ndarray) -> np.ndarray:
        n, s, q = state
        with np.errstate(divide="ignore", invalid="ignore"):
            found = {"mean": s / n, "sum": s, "std": np.sqrt(np.maximum(0.0, (q - s * s / n) / np.maximum(n - 1, 1)))}[self.kind]
        return np.where(n > 0, found, np.nan)


class _RangeCounts:
    """How many values of each replicate lie in each range between the edges."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges

    def init(self, n: int) -> np.ndarray:
        return np.zeros((len(self.edges) + 1, n), np.int64)

    def update(self, state: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
        order = np.argsort(values, kind="stable")
        at = np.searchsorted(self.edges, values[order], side="left")
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        state[at[first]] += np.add.reduceat(weights[order].astype(np.int64), first, axis=0)
        return state

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left + right


def _drawn(counts: DataFrame, n: int, seed: int) -> tuple[DataFrame, Callable[[Iterable[pd.DataFrame]], Draws]]:
    """Weights of merged values: hash buckets of distinct values, each drawn in the order of its values, so partitioning does not matter."""
    buckets = max(1, -(-counts.count() // VALUES_PER_DRAW))
    dealt = counts.withColumn("_draw", F.pmod(F.xxhash64("_v"), F.lit(buckets))).repartition("_draw").sortWithinPartitions("_draw", "_v")

    def bucket(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([seed, int(part["_draw"].iloc[0])])
        own = part["_n"].to_numpy()[:, None]
        return part["_v"].to_numpy(), np.concatenate([own, rng.poisson(own, (len(part), n))], axis=1)

    def draws(batches: Iterable[pd.DataFrame]) -> Draws:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            if not len(pdf):
                continue
            last = pdf["_draw"].iloc[-1]
            for _, part in pdf[pdf["_draw"] != last].groupby("_draw", sort=False):
                yield bucket(part)
            held = pdf[pdf["_draw"] == last]
        if held is not None and len(held):
            yield bucket(held)

    return dealt, draws


def _portable(df: DataFrame, value: Column, unit: Column, n: int, seed: int) -> tuple[DataFrame, Callable[[Iterable[pd.DataFrame]], Draws]]:
    """Weights of single rows, each a Poisson draw from the MD5 of (seed, unit, replicate): any engine can repeat them."""
    digest = lambda r: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_unit"), r.cast("string")))
    chance = lambda r: F.conv(F.substring(digest(r), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = df.select(value.cast("double").alias("_v"), unit.cast("string").alias("_unit")).where("_v IS NOT NULL AND NOT isnan(_v)")
    uniform = F.transform(F.sequence(F.lit(1), F.lit(n)), chance)
    drawn = rows.select("_v", uniform.alias("_u"))

    def draws(batches: Iterable[pd.DataFrame]) -> Draws:
        for pdf in batches:
            for a in range(0, len(pdf), VALUES_PER_DRAW):
                part = pdf.iloc[a : a + VALUES_PER_DRAW]
                weights = np.searchsorted(POISSON_ONE, np.stack(part["_u"].to_list()), side="right")
                yield part["_v"].to_numpy(), np.concatenate([np.ones((len(part), 1), np.int64), weights], axis=1)

    return drawn, draws


def _state(dealt: DataFrame, draws: Callable[[Iterable[pd.DataFrame]], Draws], metric: Aggregator, n: int) -> Any:
    """The state of the true counts and of all replicates over all rows, merged in a tree of tasks."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, some = metric.init(n + 1), False
        for values, weights in draws(batches):
            state, some = metric.update(state, values, weights), True
        if some:
            yield pd.DataFrame({"state": [pickle.dumps(state)]})

    states = settle(dealt.mapInPandas(partial, "state binary").select(F.spark_partition_id().alias("place"), "state"), "states")

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        state = pickle.loads(part["state"].iloc[0])
        for other in part["state"].iloc[1:]:
            state = metric.merge(state, pickle.loads(other))
        return pd.DataFrame({"place": [int(part["place"].iloc[0]) // FAN], "state": [pickle.dumps(state)]})

    while states.count() > 1:
        group = F.expr(f"place div {FAN}")
        states = settle(states.groupBy(group).applyInPandas(merged, "place int, state binary"), "states")
    last = states.first()
    return metric.init(n + 1) if last is None else pickle.loads(bytes(last["state"]))


def _quantiles(counts: DataFrame, value: str, dealt: DataFrame, draws: Callable, p: float, n: int) -> np.ndarray:
    """The exact, interpolated quantile of every replicate.

    A first pass counts each replicate's values per range, which locates its quantile; a second one fetches the weighted values of the one or two ranges
    it lies in. So each value is written for about a ``RANGES``-th of the replicates.
    """
    spark = counts.sparkSession
    marks = counts.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 0.25 / RANGES)
    edges = np.array(sorted(set(marks)))
    held = _state(dealt, draws, _RangeCounts(edges), n)
    total, upto = held.sum(axis=0), held.cumsum(axis=0)
    position = p * np.maximum(total - 1, 0)
    ranks = np.stack([np.floor(position), np.ceil(position)]).astype(np.int64)
    home = np.stack([(upto <= r).sum(axis=0) for r in ranks])  # ranges by replicate, for the lower and the upper rank
    shared = spark.sparkContext.broadcast((edges, home))

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts, homes = shared.value
        for values, weights in draws(batches):
            span = np.searchsorted(cuts, values, side="left")[:, None]
            at, replicate = np.nonzero(((span == homes[0]) | (span == homes[1])) & (weights > 0))
            yield pd.DataFrame({"replicate": replicate, "span": span[at, 0], "v": values[at], "w": weights[at, replicate]})

    near = settle(dealt.mapInPandas(wanted, "replicate int, span int, v double, w long").groupBy("replicate", "span", "v").agg(F.sum("w").alias("w")), "near")
    columns = range(n + 1)
    below = np.where(home > 0, np.take_along_axis(upto, np.maximum(home - 1, 0), axis=0), 0)
    spots = pd.DataFrame({"replicate": np.tile(columns, 2), "span": home.ravel(), "before": below.ravel()}).drop_duplicates()
    wants = pd.DataFrame({"replicate": list(columns), "low": ranks[0], "high": ranks[1]})
    placed = near.join(spark.createDataFrame(spots, "replicate int, span int, before long"), ["replicate", "span"])
    running = Window.partitionBy("replicate", "span").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.col("before") + F.sum("w").over(running)).join(spark.createDataFrame(wants, "replicate int, low long, high long"), "replicate")

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= F.col("end") - F.col("w")) & (F.col(rank) < F.col("end")), F.col("v"))).alias(rank)

    found = placed.groupBy("replicate").agg(at("low"), at("high")).toPandas().set_index("replicate").reindex(columns)
    return (found["low"] + (found["high"] - found["low"]) * (position - ranks[0])).to_numpy()


def bootstrap_metric(
    df: DataFrame,
    value: Column,
    metric: Aggregator | float,
    n_resamples: int = 1000,
    seed: int = 42,
    confidence: float = 0.95,
    unit: Column | None = None,
    digits: int = 4,
) -> DataFrame:
    """One row: n, estimate, low, high and n_resamples (replicates with a number) of an aggregator, or of the quantile at a number from 0 to 1.

    ``unit`` names rows uniquely and makes the draws repeatable elsewhere, at the cost of one digest per row and replicate; without it equal values are
    drawn together. Values that are not numbers are left out. What reaches the driver is one state: its size depends on replicates, not on rows.
    """
    rows = df.select(to_number(value).alias("_value"), (F.lit(0) if unit is None else unit).alias("_name"))
    counts = settle(value_counts(rows, [], F.col("_value")), "value-counts")
    if unit is None:
        dealt, draws = _drawn(counts, n_resamples, seed)
    else:
        dealt, draws = _portable(rows, F.col("_value"), F.col("_name"), n_resamples, seed)
        dealt = settle(dealt, "draws")
    if isinstance(metric, (int, float)):
        found = _quantiles(counts, "_v", dealt, draws, float(metric), n_resamples)
    else:
        found = np.asarray(metric.finish(_state(dealt, draws, metric, n_resamples)), float)
    spread = found[1:][~np.isnan(found[1:])]
    alpha = (1.0 - confidence) / 2.0
    low, high = np.quantile(spread, [alpha, 1 - alpha]).tolist() if len(spread) else (None, None)
    estimate = None if np.isnan(found[0]) else float(found[0])
    about = df.sparkSession.createDataFrame([(estimate, low, high, len(spread))], "estimate double, low double, high double, n_resamples bigint")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    return total.join(F.broadcast(about)).select("n", *[rounded(F.col(c), digits).alias(c) for c in ("estimate", "low", "high")], "n_resamples")
