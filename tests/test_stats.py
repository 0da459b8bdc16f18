import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom.functions.intervals import wilson
from surveyloom.operators import association, contradiction, evaluate, profile, psychometrics, ranks, sampling
from surveyloom.sources.tables import FACTORS, ITEMS


def test_wilson_and_summary(spark):
    low, high = wilson(F.lit(5), F.lit(10))
    row = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (row["l"], row["h"]) == (0.2366, 0.7634)
    frame = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("x",), (None,)], "v string")
    got = profile.numeric_summary(frame, ["v"]).first()
    assert (got["count"], got["missing"], got["mean"], got["median"], got["q25"]) == (4, 2, 2.5, 2.5, 1.75)
    empty = profile.numeric_summary(frame.where("v = 'x'"), ["v"]).first()
    assert (empty["count"], empty["mean"], empty["ci_high"]) == (0, 0.0, 0.0)


def test_exact_quantiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(700, 3.25), rng.lognormal(0, 2, 1300)])
    frame = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = ranks.exact_quantiles(frame, ["k"], F.col("v"), probs).first()
    assert np.allclose([got[f"q{i}"] for i in range(len(probs))], np.quantile(values, probs))


def test_dense_index_and_hash_rank(spark):
    frame = spark.range(0, 5000, 3).withColumnRenamed("id", "k").repartition(5)
    got = ranks.dense_index(frame, "k").collect()
    assert all(r["k"] == 3 * r["row_idx"] for r in got)
    ranked = ranks.hash_rank(frame.withColumn("g", F.col("k") % 2), ["g"], [F.col("k")], "r")
    assert {r["m"] for r in ranked.groupBy("g").agg((F.max("r") - F.count_distinct("r")).alias("m")).collect()} == {0}


def test_associations(spark):
    frame = spark.createDataFrame([(i, float(i), float(-i), "a" if i % 2 else "b", "x" if i % 2 else "y") for i in range(20)], "row bigint, u double, v double, c string, d string")
    assert association.pearson(frame, [("u", "v")]).first()["value"] == -1.0
    assert association.spearman(frame, [("u", "v")]).first()["value"] == -1.0
    assert association.cramers_v(frame, [("c", "d")]).first()["value"] == 1.0
    kinds = {r["column"]: r["kind"] for r in association.value_kinds(frame, ["u", "c"]).collect()}
    assert kinds == {"u": "numeric", "c": "binary"}


def test_classification_and_calibration(spark):
    rows = list(zip("aabb", "abbb", [0.9, 0.4, 0.8, 0.7], strict=True))
    frame = spark.createDataFrame(rows, "y string, p string, c double")
    got = {r["label"]: r for r in evaluate.classification_metrics(frame, "y", "p").collect()}
    assert got["a"]["accuracy"] == 0.75 and got["a"]["recall"] == 0.5 and got["b"]["support"] == 2
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in evaluate.confusion_matrix(frame, "y", "p").collect()}
    assert cells == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 2}
    assert sum(r["count"] for r in evaluate.calibration_bins(frame, "y", "p", "c").collect()) == 4


def test_regression_constant_target(spark):
    frame = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert evaluate.regression_metrics(frame, {"t": ("y", "p")}).first()["r2"] == 1.0


def test_bootstrap_is_fixed_by_seed_and_not_by_partitions(spark):
    frame = spark.range(2000).select((F.col("id") % 17).cast("double").alias("v"))
    a = profile.bootstrap_interval(frame, F.col("v"), n_resamples=200).first()
    b = profile.bootstrap_interval(frame.repartition(7), F.col("v"), n_resamples=200).first()
    assert a == b and a["low"] < a["estimate"] < a["high"]
    half = 1.96 * np.std(np.arange(2000) % 17) / np.sqrt(2000)
    assert abs((a["high"] - a["low"]) / 2 - half) < half * 0.3


def _planted(spark, n=3000):
    rng = np.random.default_rng(3)
    f = rng.multivariate_normal([0, 0, 0], [[1, 0.4, 0.2], [0.4, 1, 0.3], [0.2, 0.3, 1]], n)
    load = np.array([1.0, 0.8, 1.2] * 3)
    x = 5 + f[:, np.repeat([0, 1, 2], 3)] * load + rng.normal(0, 0.6, (n, 9))
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["survey_id", *ITEMS]), x


def test_factor_model_recovers_planted_loadings(spark):
    frame, x = _planted(spark)
    m = psychometrics.moments(frame, ITEMS)
    assert np.allclose(m.cov, np.cov(x.T, bias=True))
    model = psychometrics.fit_factor_model(frame)
    assert model.method == "confirmatory"
    own = [model.loadings[i, i // 3] for i in range(9)]
    assert np.allclose(own, [1.0, 0.8, 1.2] * 3, atol=0.08)
    assert model.fit["chi2_df"] == 24 and model.fit["cfi"] > 0.99 and model.fit["rmsea"] < 0.03
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    want = z @ model.weights
    got = psychometrics.score_rows(frame, "survey_id", model.items, model.factors, m, model.weights).orderBy("survey_id").toPandas()
    assert np.allclose(got[list(FACTORS)].to_numpy(), want, atol=1e-8)
    assert np.isclose(psychometrics.score_error(m, model.loadings), (z - want @ model.loadings.T).std())
    loadings, _, _ = psychometrics.exploratory_fit(m, 3)
    assert len({int(np.abs(loadings[i]).argmax()) for i in (0, 3, 6)}) == 3


def test_chi2_tail():
    assert abs(psychometrics.chi2_tail(41.94, 24) - 0.0131) < 5e-4
    assert abs(psychometrics.chi2_tail(3.841, 1) - 0.05) < 1e-3


def test_planted_contradictions(spark):
    rows = [(i, "ru", "short", "neutral", 0.5 + i / 1000, 0.5, 0.5) for i in range(50)]
    rows[0] = (0, "ru", "short", "negative", 0.99, 0.99, 0.99)
    rows[1] = (1, "ru", "short", "positive", 0.01, 0.01, 0.01)
    frame = spark.createDataFrame(rows, "survey_id bigint, language string, detail_level string, sentiment_class string, f1 double, f2 double, f3 double")
    flags = contradiction.contradiction_flags(frame, ["f1", "f2", "f3"])
    hit = {r["survey_id"]: (r["contradiction_type_a"], r["contradiction_type_b"]) for r in flags.where("is_contradiction").collect()}
    assert hit == {0: (True, False), 1: (False, True)}


def test_split_is_exact_and_leak_free(spark):
    frame = spark.range(18476).select(F.col("id").alias("survey_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"))
    parts = sampling.stratified_split(frame, "s")
    sizes = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert sizes == {"train": 14780, "val": 1848, "test": 1848}
    sampling.check_no_overlap(parts)
    with pytest.raises(ValueError):
        sampling.check_no_overlap(parts.union(parts.limit(1).withColumn("split", F.lit("other"))))
    with pytest.raises(ValueError):
        sampling.stratified_split(frame, "s", train=0.5)


def test_oversampling_equalises_classes(spark):
    frame = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") < 90, "a").otherwise("b").alias("y"))
    grown = sampling.oversample(frame, "y", "k")
    assert {r["y"]: r["count"] for r in grown.groupBy("y").count().collect()} == {"a": 90, "b": 90}
    assert grown.where("y = 'b' AND k < 90").count() == 0


def test_permutation_keeps_the_multiset(spark):
    frame = spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id")).alias("t"))
    moved = sampling.permute_within(frame, "k", ["t"]).collect()
    assert sorted(r["t"] for r in moved) == sorted(f"t{i}" for i in range(500))
    assert sum(r["t"] != f"t{r['k']}" for r in moved) > 400


def test_wide_correlations_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows, width = 400, 300
    x = rng.normal(0, 1, (rows, 12)) @ rng.normal(0, 1, (12, width)) + rng.normal(0, 2, (rows, width)) + 1e6 * (np.arange(width) % 3)
    x[rng.random((rows, width)) < 0.1] = np.nan
    x[:, 5], x[:, 6] = 0.1, np.nan
    x[3, 7] = np.inf
    frame = spark.createDataFrame(pd.DataFrame(x, columns=[f"v{i}" for i in range(width)]))
    got = association.pearson_matrix(frame, frame.columns).toPandas()
    assert len(got) == width * (width - 1) // 2
    r, n = np.zeros((width, width)), np.zeros((width, width))
    r[got["left"].str[1:].astype(int), got["right"].str[1:].astype(int)] = got["value"]
    n[got["left"].str[1:].astype(int), got["right"].str[1:].astype(int)] = got["n"]
    for i, j in [(a, b) for a in range(12) for b in range(a + 1, width, 7)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert n[i, j] == both.sum()
        defined = not {i, j} & {5, 6} and np.isfinite(x[both][:, [i, j]]).all()
        assert abs(r[i, j] - (np.corrcoef(x[both, i], x[both, j])[0, 1] if defined else 0.0)) < 1e-4
    few = association.pearson_matrix(frame.limit(0), frame.columns[:10]).toPandas()
    assert len(few) == 45 and set(few["value"]) == {0.0} and set(few["n"]) == {0}


def test_long_levels_are_counted_by_digest_and_shown_whole(spark):
    head = "a" * 80
    texts = [head + "z"] * 3 + [head + "b"] * 3 + [head + "c"] * 3 + ["short"] * 3 + [head] * 2 + ["#" + "0" * 64, "", "  ", None] + [head + str(i) for i in range(50)]
    frame = spark.createDataFrame([(t, "k") for t in texts], "v string, w string")
    got = profile.categorical_frequency(frame, ["v", "w"], 4).where("column = 'v'").orderBy("rank").collect()
    assert [r["level"] for r in got] == [head + "b", head + "c", head + "z", "short"] and {r["level_count"] for r in got} == {3}
    assert (got[0]["count"], got[0]["missing"], got[0]["n_unique"]) == (65, 3, 56)
    tied = profile.categorical_frequency(frame.where(F.col("v").startswith(head) & (F.length("v") > 81)), ["v"], 3).orderBy("rank").collect()
    assert [r["level"] for r in tied] == sorted(head + str(i) for i in range(10, 50))[:3]
    counts = profile.level_counts(frame, ["v"])
    assert counts.agg(F.max(F.length("level")), F.max(F.length("head"))).first()[:] == (65, 64)
    assert profile.categorical_frequency(frame.limit(0), ["v"]).count() == 0


def test_spearman_reads_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(float(i % 7), float((i * i) % 5), None if i % 9 == 0 else float(i % 3)) for i in range(200)], "a double, b double, c double").write.parquet(path)
    frame = spark.read.parquet(path)
    found = association.spearman(frame, [("a", "b"), ("a", "c"), ("b", "b")])
    assert all(path not in f for f in found.inputFiles())
    pdf = frame.toPandas()
    for r in found.collect():
        both = pdf[[r["left"], r["right"]]].dropna() if r["left"] != r["right"] else pdf[["b"]].assign(again=pdf["b"]).dropna()
        assert r["n"] == len(both) and abs(r["value"] - both.iloc[:, 0].rank().corr(both.iloc[:, 1].rank())) < 1e-4


@pytest.mark.parametrize("repeated", [False, True])
def test_split_by_cuts_is_the_ranked_split(spark, monkeypatch, repeated):
    frame = spark.range(900).select(F.when(F.col("id") % (30 if repeated else 1000) == 7, 7).otherwise(F.col("id")).alias("survey_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 880, "b").alias("s"), F.col("id").alias("text"))
    want = {(r["s"], r["split"]): r["n"] for r in sampling.stratified_split(frame, "s").groupBy("s", "split").agg(F.count("*").alias("n")).collect()}
    rows = {r["text"]: r["split"] for r in sampling.stratified_split(frame, "s").collect()}
    monkeypatch.setattr(sampling, "FEW_ROWS", 0)
    by_cuts = sampling.stratified_split(frame, "s")
    found = by_cuts.collect()
    assert {k: sum((r["s"], r["split"]) == k for r in found) for k in want} == want and len(found) == sum(want.values())
    if not repeated:
        assert {r["text"]: r["split"] for r in found} == rows
        assert "Exchange" not in by_cuts._jdf.queryExecution().executedPlan().toString()
