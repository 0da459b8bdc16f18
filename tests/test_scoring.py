"""Row-local scoring against the join form, its plan, streaming, and the classifier as a pipeline stage."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from surveyloom.functions.text import preprocess
from surveyloom.operators import classify, features, scoring
from surveyloom.operators.estimator import TextClassifier, TextClassifierModel
from surveyloom.session import settle
from surveyloom.sources.tables import survey

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cleaned(spark):
    frame = preprocess(survey(spark, SF).where("survey_id < 120")).select("survey_id", "text_processed", "language", "sentiment_class")
    odd = spark.createDataFrame([(-1, " ", "en", None), (-2, "", "en", None), (-3, "qqq zzz \U0001f600\U0001f601a \u0130", "fr", None)], frame.schema)
    return settle(frame.unionByName(odd))


@pytest.fixture(scope="module", params=["tfidf", "char_ngram"])
def model(request, cleaned):
    return classify.train_classifier(cleaned, "language", "language", request.param, max_features=3000)


def by_key(df):
    return {r["survey_id"]: r for r in df.collect()}


def test_rows_score_as_joins_do(spark, cleaned, model):
    local, joined = by_key(classify.predict_rows(model, cleaned)), by_key(classify.predict_by_join(model, cleaned))
    assert set(local) == set(joined)
    for k, r in joined.items():
        assert local[k]["pred"] == r["pred"] and np.allclose(local[k]["probabilities"], r["probabilities"], atol=1e-9)


def test_local_features_are_the_long_form(cleaned, model):
    terms = features.TERM_FAMILIES[model.family](cleaned, "survey_id", "text_processed")
    want = {r["survey_id"]: r for r in features.sparse_rows(features.tfidf(terms, model.weights, "survey_id", 3000), cleaned, "survey_id").collect()}
    table = scoring.term_table(model.weights)
    for r in scoring.local_rows(cleaned, "text_processed", model.family, table).collect():
        assert r["indices"] == want[r["survey_id"]]["indices"] and np.allclose(r["values"], want[r["survey_id"]]["values"])


def test_scoring_shuffles_nothing_and_streams(spark, cleaned, model, tmp_path):
    path = str(tmp_path / "texts")
    cleaned.write.parquet(path)
    batch = classify.predict_rows(model, spark.read.parquet(path))
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    stream = classify.predict_rows(model, spark.readStream.schema(cleaned.schema).parquet(path)).select("survey_id", "pred")
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    stream.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination(120)
    got = {r["survey_id"]: r["pred"] for r in spark.read.parquet(out).collect()}
    assert got == {r["survey_id"]: r["pred"] for r in batch.collect()}


def test_large_weights_take_the_join(monkeypatch, cleaned, model):
    want = by_key(classify.predict(model, cleaned))
    monkeypatch.setattr(scoring, "LOCAL_BYTES", 100)
    wide = classify.TextModel(**{**model.__dict__, "weights": model.weights.select("*")})
    assert wide.table() is None
    got = by_key(classify.predict(wide, cleaned))
    assert {k: r["pred"] for k, r in got.items()} == {k: r["pred"] for k, r in want.items()}
    out, summary = classify.score_table(cleaned.withColumnRenamed("survey_id", "row_idx"), [wide], overrides={"text": "text_processed"})
    assert out.count() == cleaned.count() and summary.agg(F.sum("n_predicted")).first()[0] == cleaned.count()


def test_score_table_keeps_repeated_rows(cleaned, model):
    twice = cleaned.withColumnRenamed("survey_id", "row_idx").unionByName(cleaned.withColumnRenamed("survey_id", "row_idx"))
    raw = classify.TextModel(**{**model.__dict__, "preprocess_spec": None, "name": "raw"})
    out, summary = classify.score_table(twice, [model, raw], overrides={"text": "text_processed"})
    assert out.count() == twice.count() and summary.select("model").distinct().count() == 2
    assert len([c for c in out.columns if c.endswith(("_pred", "_conf"))]) == 4


def test_pipeline_fits_saves_and_loads(cleaned, tmp_path):
    stage = TextClassifier(inputCol="text_processed", labelCol="language", maxFeatures=2000, predictionCol="said", keyCol="survey_id")
    fitted = Pipeline(stages=[stage]).fit(cleaned)
    fitted.write().save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted"))
    want = {r["survey_id"]: (r["said"], round(r["conf"], 9)) for r in fitted.transform(cleaned).collect()}
    assert {r["survey_id"]: (r["said"], round(r["conf"], 9)) for r in again.transform(cleaned).collect()} == want
    assert fitted.transform(cleaned).columns == [*cleaned.columns, "said", "conf", "probabilities"]
    stage.write().save(str(tmp_path / "stage"))
    same = TextClassifier.load(str(tmp_path / "stage"))
    assert same.getOrDefault("maxFeatures") == 2000 and same.getOrDefault("predictionCol") == "said"
    model = fitted.stages[0]
    assert isinstance(model, TextClassifierModel) and model.classes == sorted(model.classes)
    assert model.copy().transform(cleaned).count() == cleaned.count()
    with pytest.raises(ValueError, match="exist already"):
        model.transform(cleaned.withColumn("said", F.lit(1)))


def test_stored_counts_are_the_vectors(cleaned, model):
    table = scoring.term_table(model.weights)
    want = by_key(scoring.local_rows(cleaned, "text_processed", model.family, table))
    rows = settle(scoring.local_counts(cleaned.select("survey_id", "text_processed"), "text_processed", model.family, table).drop("text_processed"))
    for r in scoring.count_vectors(rows, table, len(table.terms)).collect():
        assert r["features"].indices.tolist() == want[r["survey_id"]]["indices"] and r["features"].values.tolist() == want[r["survey_id"]]["values"]


def test_tasks_share_rows_and_leave_none(spark, cleaned, tmp_path, monkeypatch):
    from pathlib import Path

    from surveyloom import session

    monkeypatch.setitem(session._RUN_DIRS, spark.sparkContext.applicationId, str(tmp_path))
    frame = cleaned.withColumn("detail_level", F.when(F.length("text_processed") > 900, "long").otherwise("short"))
    alone = by_key(classify.scored_rows(classify.train_classifier(frame, "language", "language", max_features=500), frame, "language"))
    tasks = ("language", "detail_level")
    done = classify.train_tasks(frame, frame, tasks, "tfidf", max_features=500)
    written = {p.name.rsplit("-", 5)[0] for p in Path(tmp_path).iterdir()}
    assert "rows" not in written and "vectors" not in written and "term-counts" not in written
    for task, (model, report) in zip(tasks, done, strict=True):
        got = by_key(classify.scored_rows(model, frame, task))
        right = sum(r["pred"] == r["y_true"] for r in got.values()) / len(got)
        said = {r["split"]: r["value"] for r in report.where("metric = 'accuracy'").collect()}
        assert said["train"] == pytest.approx(said["val"]) == pytest.approx(right, abs=1e-4)
        if task == "language":
            assert sum(got[k]["pred"] == alone[k]["pred"] for k in got) >= len(got) - 1


def test_results_are_written_once(spark, cleaned, model, tmp_path, monkeypatch):
    from pathlib import Path

    from surveyloom import session
    from surveyloom.plans import jobs

    monkeypatch.setitem(session._RUN_DIRS, spark.sparkContext.applicationId, str(tmp_path / "shared"))
    frame = cleaned.withColumnRenamed("survey_id", "row_idx")
    scored, summary = jobs.score_and_store(frame, [model], str(tmp_path / "analysis"), overrides={"text": "text_processed"})
    assert scored.count() == frame.count() == summary.agg(F.sum("n_predicted")).first()[0]
    assert not (tmp_path / "shared").exists() and sorted(p.name for p in Path(tmp_path / "analysis").iterdir()) == ["results", "summary"]
