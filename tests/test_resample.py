"""Bootstrap of a user's aggregator and of quantiles: against plain resampling with the same weights, and what is written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import resample
from surveyloom.plans.q_stats import TrimmedMean


def widest():
    class Widest:
        """A metric whose state is not a sum: the range of the drawn values."""

        def init(self, n):
            return np.stack([np.full(n, np.inf), np.full(n, -np.inf)])

        def update(self, state, values, weights):
            v = np.where(weights > 0, values[:, None], np.nan)
            with np.errstate(all="ignore"):
                low, high = (np.nan_to_num(f(v, axis=0), nan=e) for f, e in ((np.fmin.reduce, np.inf), (np.fmax.reduce, -np.inf)))
            return np.stack([np.minimum(state[0], low), np.maximum(state[1], high)])

        def merge(self, left, right):
            return np.stack([np.minimum(left[0], right[0]), np.maximum(left[1], right[1])])

        def finish(self, state):
            return np.where(np.isfinite(state[0]), state[1] - state[0], np.nan)

    return Widest()  # a class of a function travels to the workers by value


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(v)) for i, v in enumerate(np.round(rng.gamma(2, 4, 700), 1))] + [(900, None), (901, float("nan"))]
    return spark.createDataFrame(rows, "id long, v double").repartition(6)


def plain(frame, metric, n):
    """Draws of every replicate by the portable rule, one list of values at a time."""
    import hashlib

    rows = [(r["id"], r["v"]) for r in frame.collect() if r["v"] is not None and not np.isnan(r["v"])]
    out = [metric(np.array([v for _, v in rows]))]
    for r in range(1, n + 1):
        u = [int(hashlib.md5(f"42:{i}:{r}".encode()).hexdigest()[:8], 16) / 2**32 for i, _ in rows]
        out.append(metric(np.repeat([v for _, v in rows], np.searchsorted(resample.POISSON_ONE, u, side="right"))))
    return out[0], *np.quantile(out[1:], [0.025, 0.975])


@pytest.mark.parametrize(
    ("metric", "same"),
    [
        (TrimmedMean(2, 20), lambda v: v[(v >= 2) & (v <= 20)].mean()),
        (widest(), lambda v: v.max() - v.min()),
        (resample.Moments("std"), lambda v: v.std(ddof=1)),
        (0.3, lambda v: np.quantile(v, 0.3)),
        (1.0, lambda v: v.max()),
        (0.0, lambda v: v.min()),
    ],
)
@pytest.mark.parametrize("fan", [2, 16])
def test_metrics_equal_plain_resampling(values, metric, same, fan, monkeypatch):
    monkeypatch.setattr(resample, "FAN", fan)
    got = resample.bootstrap_metric(values, F.col("v"), metric, 25, unit=F.col("id")).first()
    assert got["n"] == 700 and got["n_resamples"] == 25
    assert np.allclose([got["estimate"], got["low"], got["high"]], plain(values, same, 25), atol=6e-5)


def test_quantile_of_merged_values(values):
    a = resample.bootstrap_metric(values, F.col("v"), 0.5, 200).first()
    b = resample.bootstrap_metric(values.repartition(3).sort("v"), F.col("v"), 0.5, 200).first()
    assert a == b and a["low"] < a["estimate"] < a["high"]


def test_quantile_writes_little(spark, monkeypatch):
    written = {}
    settle = resample.settle
    monkeypatch.setattr(resample, "settle", lambda df, name="step": written.setdefault(name, settle(df, name)))
    frame = spark.range(40_000).select((F.col("id") * 7919 % 40_000).cast("double").alias("v"))
    got = resample.bootstrap_metric(frame, F.col("v"), 0.5, 100).first()
    assert got["estimate"] == 19999.5 and got["low"] < 19999.5 < got["high"]
    assert written["near"].count() < 40_000  # not 40,000 values x 63 replicates


def test_no_values_and_one_value(spark):
    none = spark.createDataFrame([(1, None)], "id long, v double")
    for metric in (resample.Moments("mean"), 0.5, TrimmedMean(0, 1)):
        got = resample.bootstrap_metric(none, F.col("v"), metric, 10).first()
        assert (got["n"], got["estimate"], got["n_resamples"]) == (0, None, 0)
    one = spark.createDataFrame([(1, 3.0)], "id long, v double")
    got = resample.bootstrap_metric(one, F.col("v"), 0.5, 50).first()
    assert got["estimate"] == got["low"] == got["high"] == 3.0 and 0 < got["n_resamples"] < 50
    with pytest.raises(ValueError, match="unknown metric"):
        resample.Moments("median")
