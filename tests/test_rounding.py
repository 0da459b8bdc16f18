"""Rounding of large numbers, the scratch folder's guard, and plans that must not run."""

import math

import pytest
from pyspark.sql import functions as F

from surveyloom.functions.numbers import rounded
from surveyloom.functions.text import spread
from surveyloom.operators import profile, ranks
from surveyloom.session import shared_dir
from surveyloom.sources.tables import survey


@pytest.mark.parametrize("digits", [0, 2, 4, 6])
def test_large_values_are_kept(spark, digits):
    values = [1.7e15, -1.7e15, 1e18, -1e300, math.inf, -math.inf]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in frame.select(rounded(F.col("v"), digits)).collect()] == values


def test_small_values_round_half_up(spark):
    frame = spark.createDataFrame([(0.00005,), (1.23454999,), (-2.5,), (None,)], "v double")
    assert [r[0] for r in frame.select(rounded(F.col("v"))).collect()] == [0.0001, 1.2345, -2.5, None]


def test_summary_of_microseconds(spark):
    frame = spark.createDataFrame([(1700000000000000,), (1700000001000000,)], "t bigint")
    row = profile.numeric_summary(frame, ["t"]).first()
    assert (row["mean"], row["min"], row["max"]) == (1700000000500000.0, 1700000000000000.0, 1700000001000000.0)


def test_cluster_without_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_spread_starts_no_job(spark):
    frame = survey(spark, "/root/testdata/sf0.001")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "spread")
    spread(frame)
    assert not tracker.getJobIdsForGroup("spread")
    spark.sparkContext.setJobGroup("", "")


def test_positions_of_a_whole_table(spark):
    frame = spark.range(5000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("k"))
    order = [F.col("k").desc_nulls_last(), F.col("id")]
    got = {r["position"]: r["id"] for r in ranks.positions(frame, order, "position").collect()}
    want = sorted(range(5000), key=lambda i: (-(i % 7), i))
    assert [got[i + 1] for i in range(5000)] == want
