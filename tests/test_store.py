"""Commits that race, tables checked as they are written, profiles that merge, projections that converge and are kept."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import embedding, psychometrics, schema, sketches, versions
from surveyloom.operators.classify import TextModel
from surveyloom.sources import files, markers


def test_one_of_two_racing_commits_wins(spark, tmp_path):
    root = str(tmp_path / "store")

    def write(i: int) -> str:
        try:
            versions.commit(spark.range(100 * (i + 1)).toDF("id"), root, "set/a", 1, f"writer {i}")
            return "won"
        except versions.CommitConflict:
            return "lost"

    with ThreadPoolExecutor(4) as pool:
        ends = list(pool.map(write, range(4)))
    assert sorted(ends) == ["lost", "lost", "lost", "won"]
    winner = ends.index("won")
    row = versions.catalog(spark, root).collect()
    assert [(r["reason"], r["n_rows"], r["is_head"]) for r in row] == [(f"writer {winner}", 100 * (winner + 1), True)]
    assert versions.read_version(spark, root, "set/a").count() == 100 * (winner + 1)
    with pytest.raises(versions.CommitConflict):
        versions.commit(spark.range(1).toDF("id"), root, "set/a", 1)
    assert len(list((tmp_path / "store" / "data").rglob("_SUCCESS"))) == 1


def test_heads_move_one_after_the_other(spark, tmp_path):
    root = str(tmp_path / "store")
    for v in (1, 2, 3):
        versions.commit(spark.range(v).toDF("id"), root, "d", v, branch="main")
    versions.commit(spark.range(9).toDF("id"), root, "d", 4, branch="side/_x")
    versions.move_head(spark, root, "d", 1, expected=3)
    with pytest.raises(versions.CommitConflict):
        versions.move_head(spark, root, "d", 2, expected=3)
    assert versions.read_version(spark, root, "d", branch="main").count() == 1
    assert versions.read_version(spark, root, "d", branch="side/_x").count() == 9
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda v: versions.move_head(spark, root, "d", v), [1, 2, 3, 2]))
    assert versions.current_head(spark, root, "d")[1] == 3 + 1 + 4
    assert versions.current_head(spark, root, "unknown") == (None, 0)


def test_marker_is_created_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "a" / "m.json")
    assert markers.create_once(spark, path, "first") and not markers.create_once(spark, path, "second")
    assert open(path, encoding="utf-8").read() == "first"
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.startswith(".")] == ["m.json"]


BROKEN = '1,"a ""quoted""\nline",en,3\n2,too few\n3,x,en,4,too many\n,,,\n5,y,xx,11\n6,z,,no number\n'


@pytest.mark.parametrize("multi_line", [True, False])
def test_checks_are_counted_by_the_pass_that_writes(spark, tmp_path, multi_line):
    path = tmp_path / "t.csv"
    path.write_text(BROKEN if multi_line else BROKEN.replace("\nline", " line"), encoding="utf-8")
    columns = ["survey_id", "text_feedback", "language", "item_1"]
    marked = files.read_marked(spark, str(path), columns, header=False, multi_line=multi_line)
    bad = [r[files.BAD_RECORD].strip() for r in marked.where(F.col(files.BAD_RECORD).isNotNull()).collect()]
    assert bad == ["2,too few", "3,x,en,4,too many"]
    context = spark.sparkContext
    context.setJobGroup(f"checked-{multi_line}", "one write")
    report = files.write_checked(marked, str(tmp_path / "out"), domains={"language": ["en"]})
    jobs = context.statusTracker().getJobIdsForGroup(f"checked-{multi_line}")
    context.setJobGroup("other", "other")
    assert len(jobs) == 1
    found = {(r["column"], r["rule"]): r["n_bad"] for r in report.collect()}
    assert {k: v for k, v in found.items() if k[1] != "missing"} == {
        (None, "rows"): 4, (None, "empty"): 1, (None, "malformed"): 2, ("item_1", "range"): 2, ("language", "domain"): 1,
    }
    assert {k[0] for k in found if k[1] == "missing"} == set(files.SURVEY_COLUMNS) - set(columns)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == columns and back.count() == 4


def test_checks_of_an_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "survey_id int, item_1 int")
    found = {(r["column"], r["rule"]): r["n_bad"] for r in files.write_checked(frame, str(tmp_path / "out"), required=["item_1", "item_2"]).collect()}
    assert found == {(None, "rows"): 0, (None, "empty"): 0, (None, "malformed"): 0, ("item_1", "range"): 0, ("item_2", "missing"): 1}


def test_roles_with_filled_cells(spark):
    frame = spark.createDataFrame([("a", 1, " "), (None, 2, "en")], "`  comment ` string, n int, language string")
    assert {tuple(r) for r in schema.role_report(frame).collect()} == {("  comment ", "text", 1), ("language", "language", 1)}
    assert schema.role_report(frame.select("n")).count() == 0


def test_merged_sketches_are_those_of_the_union(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 40_009).alias("many"), (F.col("id") % 11).cast("string").alias("few"), F.lit(1e9).alias("same") + F.col("id") % 3, F.lit(None).cast("string").alias("none")
    )
    rows = rows.toDF("many", "few", "same", "none")
    columns = rows.columns
    sketches.store_sketches(sketches.sketch_columns(rows.limit(0), columns), str(tmp_path / "0"))
    at = str(tmp_path / "0")
    for i, share in enumerate(["few = '3'", "few < '2'", "few NOT IN ('3') AND few >= '2'"], 1):
        merged = sketches.grown_profile(spark, at, rows.where(share), columns, str(tmp_path / str(i)))
        at = str(tmp_path / str(i))
    whole = sketches.sketch_columns(rows, columns)
    one = {r["column"]: r.asDict() for r in sketches.sketched_profile(merged).collect()}
    two = {r["column"]: r.asDict() for r in sketches.sketched_profile(whole).collect()}
    exact = rows.agg(F.count_distinct("many").alias("d"), F.stddev_samp("same").alias("s")).first()
    quartiles = ["q25", "median", "q75"]
    for c in columns:
        assert {k: v for k, v in one[c].items() if k not in quartiles} == {k: v for k, v in two[c].items() if k not in quartiles}
    assert abs(one["many"]["n_unique"] - exact["d"]) <= 4 * 1.04 / 2 ** (sketches.PRECISION / 2) * exact["d"]
    assert abs(one["same"]["std"] - exact["s"]) < 1e-4
    assert one["none"]["n_null"] == 60_000 and one["none"]["mean"] is None and one["none"]["median"] is None
    n = rows.where("many IS NOT NULL").count()
    for c, p in zip(quartiles, [0.25, 0.5, 0.75], strict=True):
        rank = rows.where(F.col("many") <= one["many"][c]).count() / n
        assert abs(rank - p) < 3 * 2.3 / sketches.SIZE**0.9 + 1e-4


def dense(spark, x):
    rows = [(i, list(range(x.shape[1])), [float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, "k int, indices array<int>, values array<double>")


@pytest.mark.parametrize("exact", [embedding.EXACT_SIZE, 0])
def test_projection_converges_to_the_components(spark, monkeypatch, exact):
    monkeypatch.setattr(embedding, "EXACT_SIZE", exact)
    monkeypatch.setattr(embedding, "CHUNK", 64)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 30)) * np.linspace(1.0, 1.6, 30) + 5.0  # variances close to each other: six passes are too few
    found = embedding.project(dense(spark, x), "k", 30, tolerance=1e-6)
    assert found.converged and (found.passes == 1 if exact else found.passes > 6)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    turned = vt[:2] * np.sign(vt[:2][np.arange(2), np.abs(vt[:2]).argmax(axis=1)])[:, None]
    got = np.array([[r["x"], r["y"]] for r in found.points.orderBy("k").collect()])
    assert np.allclose(got, (x - x.mean(axis=0)) @ turned.T, atol=1e-3)
    assert np.allclose(found.shares, (s**2 / (s**2).sum())[:2])
    if not exact:
        short = embedding.project(dense(spark, x), "k", 30, passes=2)
        assert not short.converged and short.passes == 2 and short.residual > embedding.TOLERANCE


@pytest.mark.parametrize("exact", [embedding.EXACT_SIZE, 0])
def test_projection_of_degenerate_rows(spark, monkeypatch, exact):
    monkeypatch.setattr(embedding, "EXACT_SIZE", exact)
    same = embedding.project(dense(spark, np.ones((5, 3))), "k", 3)
    assert same.converged and all(abs(r["x"]) < 1e-9 and abs(r["y"]) < 1e-9 for r in same.points.collect())
    line = embedding.project(dense(spark, np.outer(np.arange(6.0), [3.0, 4.0, 0.0])), "k", 3)
    assert line.converged and np.allclose(sorted(r["x"] for r in line.points.collect()), 5 * (np.arange(6) - 2.5))
    assert embedding.project(dense(spark, np.ones((5, 3))).limit(0), "k", 3).points.count() == 0


def test_projection_by_a_model_sees_its_terms_only(spark):
    texts = [(0, "red red blue"), (1, "blue green"), (2, "red green green"), (3, "unknown words"), (4, None), (5, "red")]
    docs = spark.createDataFrame(texts, "survey_id int, text_feedback string").withColumn("language", F.lit(None).cast("string"))
    weights = spark.createDataFrame([("red", 0, 1.0, [0.0]), ("blue", 1, 2.0, [0.0]), ("green", 2, 1.5, [0.0])], "term string, idx int, idf double, w array<double>")
    model = TextModel("m", "language", "tfidf", ["a"], weights, [0.0], 10, "text_feedback")
    counts = np.array([[2, 1, 0], [0, 1, 1], [1, 0, 2], [0, 0, 0], [0, 0, 0], [1, 0, 0]], float)
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * [1.0, 2.0, 1.5]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    _, _, vt = np.linalg.svd(x - x.mean(axis=0))
    turned = vt[:2] * np.sign(vt[:2][np.arange(2), np.abs(vt[:2]).argmax(axis=1)])[:, None]
    found = embedding.project_by_model(model, docs, "survey_id")
    rows = found.points.orderBy("survey_id").collect()
    assert found.converged and np.allclose([[r["x"], r["y"]] for r in rows], (x - x.mean(axis=0)) @ turned.T, atol=1e-4)
    assert {r["language"] for r in rows} == {""}
    other = TextModel("m", "language", "tfidf", ["a"], weights.withColumn("idf", F.col("idf") + 1), [0.0], 10, "text_feedback")
    assert embedding.model_id(model) == embedding.model_id(model) != embedding.model_id(other)


def test_points_are_kept_by_snapshot_model_and_parameters(spark, tmp_path):
    root, built = str(tmp_path), []

    def build():
        built.append(1)
        return spark.range(3).select(F.col("id").alias("k"), F.lit(len(built)).alias("x"))

    def x(*known):
        return embedding.cached_points(spark, root, *known, build).first()["x"]

    assert [x("s1", "m", {"a": 1}), x("s1", "m", {"a": 1}), x("s1", "m", {"a": 2}), x("s1", "n", {"a": 1}), x("s2", "m", {"a": 1})] == [1, 1, 2, 3, 4]
    embedding.forget_points(spark, root, "s1")
    assert [x("s1", "m", {"a": 1}), x("s2", "m", {"a": 1})] == [5, 4]

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        embedding.cached_points(spark, root, "s3", "m", {}, broken)
    assert x("s3", "m", {}) == 6


def test_an_unconverged_factor_model_is_refused(spark):
    rng = np.random.default_rng(5)
    f = rng.standard_normal((500, 2))
    data = np.repeat(f, 3, axis=1) + 0.6 * rng.standard_normal((500, 6))
    items = [f"i{n}" for n in range(6)]
    frame = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{i} double" for i in items))
    m = psychometrics.moments(frame, items)
    groups = {"a": items[:3], "b": items[3:]}
    loadings, fit = psychometrics.confirmatory_fit(m, groups)
    assert fit["cfi"] > 0.95 and np.all(loadings[:3, 1] == 0)
    with pytest.raises(ValueError):
        psychometrics.confirmatory_fit(m, groups, max_iter=2)
    assert psychometrics.exploratory_fit(m, 2)[2]["converged"]
    assert not psychometrics.exploratory_fit(m, 2, max_iter=2)[2]["converged"]
