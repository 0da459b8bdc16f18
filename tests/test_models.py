import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom.functions.text import preprocess
from surveyloom.operators import classify, density, embedding, features, versions


@pytest.fixture(scope="module")
def feedback(spark):
    words = {"positive": "great excellent", "neutral": "plain ordinary", "negative": "awful terrible"}
    rows = [(i, f"{words[c]} course number {i}", c) for i, c in enumerate(list(words) * 15)]
    return preprocess(spark.createDataFrame(rows, "survey_id bigint, text_feedback string, sentiment_class string")).cache()


def test_classifier_learns_saves_and_explains(spark, feedback, tmp_path):
    model = classify.train_classifier(feedback, "sentiment", "sentiment_class")
    scored = classify.scored_rows(model, feedback, "sentiment_class")
    assert scored.where("pred = y_true").count() == 45
    path = str(tmp_path / "model")
    model.save(path)
    again = classify.TextModel.load(spark, path)
    assert again.classes == model.classes
    assert classify.predict(again, feedback).where(F.col("conf") > 0.33).count() == 45
    top = classify.global_importance(model, 4).where("class = 'negative'").collect()
    assert {"awful", "terrible"} & {r["feature"] for r in top}
    why = classify.explain_rows(model, feedback.where("survey_id = 2"), top_n=2).collect()
    assert any("awful" in r["feature"] or "terrible" in r["feature"] for r in why)
    short = classify.warm_start(model, feedback, "sentiment_class", C=9.0, max_iter=1, tol=1e-12)
    assert short.metrics == {"converged": False, "steps": 1}
    warm = classify.warm_start(model, feedback, "sentiment_class")
    assert warm.metrics["converged"] and classify.scored_rows(warm, feedback, "sentiment_class").where("pred = y_true").count() == 45
    assert classify.warm_start(model, feedback.where("sentiment_class <> 'neutral'"), "sentiment_class") is None
    odd = classify.TextModel(**{**model.__dict__, "name": "odd", "preprocess_spec": "v9"})
    raw = feedback.select(F.col("survey_id").alias("row_idx"), "text_feedback")
    out, summary = classify.score_table(raw, [model, odd])
    assert out.count() == 45 and summary.where("error IS NOT NULL").count() == 1


def test_tfidf_matches_numpy(spark):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b c"), (2, "")], "k bigint, t string")
    terms = features.word_terms(docs, "k", "t", 1, 1)
    vocab = features.with_idf(features.vocabulary(terms, "k", 10), docs)
    got = {(r["k"], r["term"]): r["weight"] for r in features.tfidf(terms, vocab, "k", 10).collect()}
    idf = {t: np.log(4 / (1 + n)) + 1 for t, n in {"a": 1, "b": 2, "c": 1}.items()}
    a, b = (1 + np.log(2)) * idf["a"], idf["b"]
    assert np.isclose(got[0, "a"], a / np.hypot(a, b)) and (2, "a") not in got


def _points(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "row_idx bigint, x double, y double")


def _brute_dbscan(xy, eps, m):
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    near = d <= eps
    core = near.sum(1) >= m
    label = np.full(len(xy), -1)
    c = 0
    for i in range(len(xy)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = c
            while stack:
                j = stack.pop()
                for k in np.flatnonzero(near[j] & core & (label < 0)):
                    label[k] = c
                    stack.append(k)
            c += 1
    for i in np.flatnonzero(~core):
        hit = near[i] & core
        label[i] = label[hit].min() if hit.any() else -1
    return core, label


def test_dbscan_matches_brute_force_with_crowded_cells(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(0, 0.05, (300, 2)), rng.normal([0.55, 0], 0.08, (250, 2)), np.tile([[3.0, 3.0]], (40, 1)), rng.uniform(-2, 4, (150, 2))])
    for eps, m in ((0.2, 5), (0.35, 8)):
        core, label = _brute_dbscan(xy, eps, m)
        got = density.dbscan(_points(spark, xy), "row_idx", eps, m).orderBy("row_idx").toPandas()
        assert (got["is_core"].to_numpy() == core).all()
        assert (got["cluster"].to_numpy() == label).all()


def test_crowded_pairs_descend_to_smaller_boxes(spark, monkeypatch):
    monkeypatch.setattr(density, "MAX_PAIRS", 4)
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.uniform([0, 0], [0.3, 1.0], (120, 2)), rng.uniform([0.42, 0], [0.7, 1.0], (120, 2))])
    _, label = _brute_dbscan(xy, 0.15, 4)
    got = density.dbscan(_points(spark, xy), "row_idx", 0.15, 4).orderBy("row_idx").toPandas()
    assert (got["cluster"].to_numpy() == label).all()


def _brute_lof(xy, k):
    n = len(xy)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    near = []
    for i in range(n):
        order = sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], xy[j, 0], xy[j, 1]))
        near.append(order[:k])
    kd = np.array([d[i, near[i]].max() for i in range(n)])
    lrd = np.array([k / (np.maximum(d[i, near[i]], kd[near[i]]).sum() + 1e-10 * k) for i in range(n)])
    return np.array([lrd[near[i]].mean() / lrd[i] for i in range(n)])


def test_lof_matches_brute_force_across_leaves(spark):
    rng = np.random.default_rng(7)
    xy = np.concatenate([rng.normal(0, 1, (220, 2)), np.tile([[0.5, 0.5]], (30, 1)), [[9.0, 9.0]]])
    got = density.local_outlier_factor(_points(spark, xy), "row_idx", 5, leaf_rows=16).orderBy("row_idx").toPandas()
    assert np.allclose(got["outlier_score"], _brute_lof(xy, 5), rtol=1e-6)


@pytest.mark.parametrize("shape", ["equal_x", "equal_y", "cross", "spread"])
def test_leaves_are_bounded_where_an_axis_repeats(spark, shape):
    rng = np.random.default_rng(9)
    a = rng.permutation(6000) / 7.0
    x, y = {"equal_x": (a * 0, a), "equal_y": (a, a * 0), "cross": (np.where(a < 400, 0, a), np.where(a < 400, a, 0)), "spread": (a, np.exp(a % 30))}[shape]
    places = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "w": 1})).withColumn("w", F.col("w").cast("bigint"))
    leafed, levels = density._leaves(places, 64)
    sizes = [r["count"] for r in leafed.groupBy("leaf").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 64 and len(sizes) < 6000 / 8 and len(levels) < 8


@pytest.mark.parametrize("shape", ["line", "ties", "far"])
def test_neighbours_equal_brute_force_on_awkward_shapes(spark, shape):
    rng = np.random.default_rng(10)
    xy = {
        "line": np.stack([np.zeros(300), rng.permutation(300) / 3.0], 1),
        "ties": np.stack(np.meshgrid(np.arange(18.0), np.arange(18.0)), -1).reshape(-1, 2),
        "far": np.concatenate([rng.normal(0, 1, (200, 2)), np.stack([10.0 ** np.arange(1, 40), np.zeros(39)], 1)]),
    }[shape]
    got = density.local_outlier_factor(_points(spark, xy), "row_idx", 5, leaf_rows=16).orderBy("row_idx").toPandas()
    assert np.allclose(got["outlier_score"], _brute_lof(xy, 5), rtol=1e-6)


def test_isolation_forest_finds_the_far_point(spark):
    rng = np.random.default_rng(8)
    points = _points(spark, np.concatenate([rng.normal(0, 1, (400, 2)), [[12.0, 12.0]]]))
    scored = embedding.flag_top_share(density.isolation_scores(points, "row_idx"), contamination=0.05)
    assert scored.orderBy(F.desc("outlier_score")).first()["row_idx"] == 400
    assert abs(scored.where("is_outlier").count() - 20) <= 2


def test_lineage_is_cycle_safe(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")], "id string, parent string")
    got = {(r["node"], r["ancestor"], r["depth"]) for r in versions.lineage(nodes, "id", "parent").collect()}
    assert got == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2), ("x", "y", 1), ("y", "x", 1)}


def test_ancestors_of_wanted_nodes_only(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")], "id string, parent string")
    wanted = nodes.where("id IN ('c', 'x', 'z')")
    got = {(r["node"], r["ancestor"], r["depth"]) for r in versions.ancestors(nodes, wanted, "id", "parent").collect()}
    assert got == {("c", "b", 1), ("c", "a", 2), ("x", "y", 1)}
    assert versions.ancestors(nodes, nodes.limit(0), "id", "parent").count() == 0
    chain = spark.range(5000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    far = versions.ancestors(chain, chain.where("id = 4999"), "id", "parent")
    assert far.count() == 4999 and far.where("node - ancestor <> depth").isEmpty()


def test_no_row_is_lost_without_neighbours_or_place(spark):
    rows = [(i, float(i % 5), float(i // 5)) for i in range(20)] + [(90, None, 1.0), (91, 2.0, float("nan"))]
    points = spark.createDataFrame(rows, "row_idx long, x double, y double")
    scores = {r["row_idx"]: r["outlier_score"] for r in density.local_outlier_factor(points, "row_idx", 3).collect()}
    assert len(scores) == 22 and scores[90] is scores[91] is None and None not in [scores[i] for i in range(20)]
    assert density.dbscan_flags(points, "row_idx", 1.1, 3).count() == density.dbscan(points, "row_idx", 1.1, 3).count() == 22
    assert density.dbscan(points, "row_idx", 1.1, 3).where("row_idx >= 90 and cluster = -1").count() == 2
    forest = density.isolation_scores(points, "row_idx")
    assert forest.count() == 22 and forest.where("outlier_score IS NULL").count() == 2
    one = points.where("row_idx = 3")
    assert [r["outlier_score"] for r in density.local_outlier_factor(one, "row_idx").collect()] == [1.0]
    for some, used in ((points, "lof"), (one, "isolation_forest"), (points.where("row_idx < 3"), "lof"), (points.where("row_idx > 50"), "isolation_forest")):
        table, about = embedding.outlier_table(some, "row_idx", neighbours=50)
        assert table.count() == some.count() and about.first()["method"] == used and about.first()["n_rows"] == some.count()
    assert embedding.outlier_table(points, "row_idx", neighbours=50)[1].first()["n_neighbors"] == 19
    for method in ("kmeans", "dbscan"):
        table, counts = embedding.cluster_table(points, "row_idx", method, k=3, eps=1.1, min_samples=3)
        assert table.count() == 22 and counts.agg(F.sum("n")).first()[0] == 22 and table.where("row_idx >= 90 and cluster = -1").count() == 2
    assert embedding.cluster_table(points.where("row_idx > 90"), "row_idx")[1].first()["cluster"] == -1


def test_small_training_tables_have_a_task_per_core(spark):
    from surveyloom.session import packed

    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 100, 1, 64)
    assert packed(rows, 100).rdd.getNumPartitions() == 1
    assert packed(rows, 19_000).rdd.getNumPartitions() == min(cores, 10)
    assert packed(rows, 1_000_000).rdd.getNumPartitions() == max(50, min(cores, 64))
