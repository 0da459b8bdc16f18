"""Queries: features, models, projection, clusters and outliers, versioned tables, end-to-end jobs."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from surveyloom.functions.numbers import rounded
from surveyloom.functions.text import preprocess, spread
from surveyloom.operators import classify, density, embedding, estimator, evaluate, features, fusion, psychometrics, sampling, versions
from surveyloom.operators.common import with_scalars
from surveyloom.operators.predicates import subset
from surveyloom.plans import jobs
from surveyloom.plans.q_stats import (
    LOADINGS,
    SQL_FLAGS,
    SQL_LOADINGS,
    SQL_RATES,
    SQL_RUNS,
    _alpha_sql,
    _flags,
    _FULL,
    _LEFT,
    _loadings,
    _run,
    _share,
    sql_calibration,
    sql_classification,
    sql_cramers,
    sql_descriptive,
    sql_pearson,
    sql_spearman,
    union,
)
from surveyloom.plans.q_tables import SQL_CHAR_TERMS, SQL_WORD_TERMS, not_blank
from surveyloom.plans.registry import query, r
from surveyloom.session import release, scratch_path, settle
from surveyloom.sources.tables import FACTORS, ITEMS, LABELS, predictions, results, survey, table


def sql_tfidf(cap: int, source: str, sublinear: bool = True) -> str:
    """Long TF-IDF of the relation ``terms`` (k, term, tf) over the documents of ``source``."""
    tf = "(1.0 + ln(tf))" if sublinear else "tf::DOUBLE"
    return f"""voc AS (SELECT term, sum(tf) AS total, count(*) AS df FROM terms GROUP BY term ORDER BY total DESC, term LIMIT {cap}),
    idf AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM voc, (SELECT count(*)::DOUBLE AS n FROM {source})),
    raw AS (SELECT k, term, {tf} * idf AS w FROM terms JOIN idf USING (term)),
    tfidf AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM raw)"""


_DOC_SUMMARY = f"SELECT k AS doc_id, count(*) AS n_terms, {r('sum(w)', 6)} AS weight_sum, {r('max(w)', 6)} AS weight_max, max(term) AS last_term FROM tfidf GROUP BY k"


def _doc_summary(bags):
    return bags.select(
        "doc_id",
        F.size("entries").cast("bigint").alias("n_terms"),
        rounded(F.aggregate("entries.weight", F.lit(0.0), lambda a, w: a + w), 6).alias("weight_sum"),
        rounded(F.array_max("entries.weight"), 6).alias("weight_max"),
        F.array_max("entries.term").alias("last_term"),
    )


def _tfidf(spark, sf, family: str, cap: int):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    terms = features.TERM_FAMILIES[family](docs, "doc_id", "text")
    vocab = settle(features.with_idf(features.vocabulary(terms, "doc_id", cap), docs), "vocabulary")
    return features.tfidf_bags(docs, "doc_id", "text", family, vocab, cap)


@query("k1_word_tfidf", f"WITH {SQL_WORD_TERMS.format(k='doc_id', x='text', t='documents')}, {sql_tfidf(50000, 'documents')} {_DOC_SUMMARY}")
def _k1(spark, sf):
    return _doc_summary(_tfidf(spark, sf, "tfidf", 50_000))


@query("k2_char_tfidf", f"WITH {SQL_CHAR_TERMS.format(k='doc_id', x='text', t='documents', lo=2, hi=5)}, {sql_tfidf(100000, 'documents')} {_DOC_SUMMARY}")
def _k2(spark, sf):
    return _doc_summary(_tfidf(spark, sf, "char_ngram", 100_000))


def _cleaned(spark, sf):
    return settle(preprocess(spread(survey(spark, sf))), "cleaned")


def _labelled(spark, sf, label: str = "sentiment_class"):
    """Cleaned rows with the label the split goes by; others have no part in it and are not cleaned."""
    return settle(preprocess(spread(survey(spark, sf)).where(F.col(label).isNotNull())), "cleaned")


def _split(cleaned, label: str = "sentiment_class"):
    parts = sampling.stratified_split(cleaned, label)
    return tuple(parts.where(F.col("split") == s) for s in ("train", "val", "test"))


def _parts(spark, sf, label: str = "sentiment_class"):
    return _split(_labelled(spark, sf, label), label)


@query("k3_balanced_logistic_regression")
def _k3(spark, sf):
    train, _, test = _parts(spark, sf)
    model = classify.train_classifier(train, "language", "language", "tfidf")
    return classify.predict(model, test).select("survey_id", "pred", "conf")


@query("k4_train_task")
def _k4(spark, sf):
    train, val, _ = _parts(spark, sf)
    return classify.train_task(train, val, "sentiment", "tfidf")[1]


@query("k5_train_all_tasks")
def _k5(spark, sf):
    train, val, _ = _parts(spark, sf)
    return classify.train_all(train, val)[1]


def _two_models(spark, sf):
    cleaned = _labelled(spark, sf)
    train, _, _ = _split(cleaned)
    fitted = classify.train_classifier(train, "language", "language", "tfidf", name="words")
    chars = classify.train_classifier(train, "sentiment", "sentiment_class", "char_ngram", name="chars")
    foreign = classify.TextModel(**{**fitted.__dict__, "name": "foreign", "preprocess_spec": "other_v9"})
    release(cleaned)
    return [fitted, chars, foreign]


@query("k6_batch_scoring")
def _k6(spark, sf):
    frame = survey(spark, sf).withColumnRenamed("survey_id", "row_idx")
    _, summary = classify.score_table(frame, _two_models(spark, sf), "row_idx")
    return summary


@query("k7_user_training_job")
def _k7(spark, sf):
    frame = survey(spark, sf).select("survey_id", F.col("text_feedback").alias("comment"), F.col("sentiment_class").alias("tone"))
    out = classify.training_job(frame, "sentiment", stored={"comment": "text", "tone": "sentiment"}, balancing="oversample")
    return union([m.select(F.lit(s).alias("split"), "*") for s, m in out["metrics"].items()])


@query("k8_warm_start")
def _k8(spark, sf):
    train, val, test = _parts(spark, sf)
    base = classify.train_classifier(train, "language", "language", "tfidf")
    warm = classify.warm_start(base, val, "language") or classify.train_classifier(val, "language", "language", "tfidf")  # other classes: a fresh fit
    sides = [classify.model_metrics(m, test, "language").select(F.lit(n).alias("model"), "*") for n, m in (("base", base), ("warm", warm))]
    return union(sides)


@query("k9_model_comparison")
def _k9(spark, sf):
    train, _, test = _parts(spark, sf)
    words = classify.train_classifier(train, "detail_level", "detail_level", "tfidf")
    chars = classify.train_classifier(train, "detail_level", "detail_level", "char_ngram")
    return classify.compare_models(words, chars, test, "detail_level")


VOCABULARY = classify.MAX_FEATURES["tfidf"]

# A weight table from class-wise document counts, so that importance and explanations have exact counterparts.
SQL_WEIGHTS = f"""{SQL_WORD_TERMS.format(k="survey_id", x="text_feedback", t="pred")}, {sql_tfidf(VOCABULARY, "pred")},
  cc AS (SELECT sentiment_class AS class, term, count(*) AS c FROM terms JOIN pred ON pred.survey_id = k JOIN voc USING (term) GROUP BY ALL),
  wt AS (SELECT c.class, v.term, ln((coalesce(cc.c, 0) + 1.0) / (v.df + 3.0)) AS weight FROM (SELECT DISTINCT sentiment_class AS class FROM pred) c CROSS JOIN voc v LEFT JOIN cc ON cc.class = c.class AND cc.term = v.term)"""


def _weights(spark, sf):
    docs = settle(predictions(spark, sf).select("survey_id", "text_feedback", "sentiment_class", "y_pred"), "docs")
    terms = features.word_terms(spread(docs), "survey_id", "text_feedback")
    vocab = settle(features.with_idf(features.vocabulary(terms, "survey_id", VOCABULARY), docs), "vocabulary")
    named = docs.where("survey_id IS NOT NULL")
    classed = features.term_bags(spread(named), "survey_id", "text_feedback", "tfidf", keep=("sentiment_class",))
    counts = (
        features.join_terms(classed.select("sentiment_class", F.inline("terms")), vocab.select("term"), VOCABULARY)
        .groupBy("term")
        .pivot("sentiment_class", ["negative", "neutral", "positive"])
        .count()
        .fillna(0)
    )
    present = [r["sentiment_class"] for r in docs.select("sentiment_class").distinct().orderBy("sentiment_class").collect()]
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("class"), F.log((F.col(c) + 1.0) / (F.col("df") + 3.0)).alias("weight"))
            for c in present
        ]
    )
    weights = vocab.join(counts, "term", "left").fillna(0).select("term", F.inline(cells))
    return docs, vocab, settle(weights, "weights")


@query(
    "k10_global_importance",
    f"WITH {SQL_WEIGHTS} SELECT class, CAST(row_number() OVER (PARTITION BY class ORDER BY weight DESC, term) AS INT) AS rank, term AS feature, {r('weight', 6)} AS weight FROM wt QUALIFY rank <= 20",
)
def _k10(spark, sf):
    return classify.top_weights(_weights(spark, sf)[2], 20)


@query(
    "k11_local_explanation",
    f"""WITH {SQL_WEIGHTS}, cb AS (SELECT k AS survey_id, term, w AS value, weight, w * weight AS c FROM tfidf JOIN pred ON pred.survey_id = k JOIN wt USING (term) WHERE wt.class = pred.y_pred)
    SELECT survey_id, CAST(row_number() OVER (PARTITION BY survey_id ORDER BY abs(c) DESC, term) AS INT) AS rank, term AS feature, {r("value", 6)} AS value, {r("weight", 6)} AS weight, {r("c", 6)} AS contribution
    FROM cb QUALIFY rank <= 10""",
)
def _k11(spark, sf):
    docs, vocab, weights = _weights(spark, sf)
    named = spread(docs.where("survey_id IS NOT NULL")).withColumnRenamed("y_pred", "pred")
    entries = features.tfidf_bags(named, "survey_id", "text_feedback", "tfidf", vocab, VOCABULARY, keep=("pred",))
    cells = entries.select("survey_id", "pred", F.inline("entries"))
    return classify.local_contributions(cells.select("survey_id", "pred", "term", F.col("weight").alias("value")), weights, None, "survey_id")


@query(
    "p1_classifier_stage",
    f"""WITH {SQL_WEIGHTS}, sums AS (SELECT survey_id, class, sum(coalesce(f.w * wt.weight, 0)) AS z FROM (SELECT survey_id, class FROM pred CROSS JOIN (SELECT DISTINCT class FROM wt)) p
      LEFT JOIN tfidf f ON f.k = p.survey_id LEFT JOIN wt USING (class, term) GROUP BY survey_id, class),
    e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY survey_id)) AS x FROM sums)
    SELECT survey_id, first(class ORDER BY x DESC, class) AS pred, {r("max(x) / sum(x)", 6)} AS conf FROM e GROUP BY survey_id""",
)
def _p1(spark, sf):
    docs, model = _fixed_model(spark, sf)
    stage = estimator.TextClassifierModel(model).setParams(inputCol="text_feedback")
    path = scratch_path(spark, "pipeline")
    PipelineModel([stage]).write().save(path)
    scored = PipelineModel.load(path).transform(docs)
    return scored.select("survey_id", "pred", rounded(F.col("conf"), 6).alias("conf"))


def _fixed_model(spark, sf):
    """Documents, and a model whose weights are class-wise document counts."""
    docs, vocab, weights = _weights(spark, sf)
    classes = [c[0] for c in weights.select("class").distinct().orderBy("class").collect()]
    by_term = weights.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "weight"))), lambda w: w["weight"]).alias("w"))
    table_of = settle(vocab.join(by_term, "term"), "fixed-weights")
    model = classify.TextModel("fixed", "sentiment", "tfidf", classes, table_of, [0.0] * len(classes), VOCABULARY, "text_feedback")
    return docs, model


def _fusion_parts(spark, sf):
    frame = _cleaned(spark, sf)
    scores = psychometrics.score_with_loadings(frame, "survey_id", ITEMS, list(FACTORS), LOADINGS)
    joined = settle(sampling.stratified_split(frame, "language").join(scores, "survey_id"), "scored")
    train = joined.where(F.col("split") == "train")
    packed, _ = fusion.text_features(train, joined, "survey_id", "text_processed")
    both = settle(joined.join(packed, "survey_id"), "fused")
    return both.where(F.col("split") == "train"), both.where(F.col("split") == "test")


@query("k12_huber_regression")
def _k12(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    train, test = _fusion_parts(spark, sf)
    assemble = VectorAssembler(inputCols=ITEMS, outputCol="features")
    hat = fusion.huber_predictions(assemble.transform(train), assemble.transform(test), "survey_id", "features", list(FACTORS))
    return evaluate.regression_metrics(hat, {t: (t, f"{t}_hat") for t in FACTORS})


@query("k13_late_fusion")
def _k13(spark, sf):
    return fusion.compare_views(*_fusion_parts(spark, sf), "survey_id", ITEMS, list(FACTORS))


@query("k14_ablations")
def _k14(spark, sf):
    return fusion.ablations(*_fusion_parts(spark, sf), "survey_id", ITEMS, list(FACTORS))


@query(
    "k15_train_standardization",
    f"""WITH st AS (SELECT avg(conf) AS mc, stddev_pop(conf) AS sc, avg(coalesce(item_1, 0)::DOUBLE) AS mi, stddev_pop(coalesce(item_1, 0)::DOUBLE) AS si FROM pred WHERE survey_id % 5 <> 0)
    SELECT survey_id, {r("(conf - mc) / sc", 6)} AS conf_z, {r("(coalesce(item_1, 0) - mi) / (si + 1e-8::DOUBLE)", 6)} AS item_z FROM pred, st WHERE survey_id % 5 = 0""",
)
def _k15(spark, sf):
    rows = predictions(spark, sf).select("survey_id", "conf", "item_1")
    train, test = rows.where("survey_id % 5 <> 0"), rows.where("survey_id % 5 = 0")
    scaled = fusion.standardize(train, fusion.standardize(train, test, ["conf"]), ["item_1"], guard=1e-8)
    return scaled.select("survey_id", rounded(F.col("conf_z"), 6).alias("conf_z"), rounded(F.col("item_1_z"), 6).alias("item_z"))


@query(
    "k16_sensitivity",
    f"""WITH sl AS (SELECT sentiment_class, y_pred, 'language' AS slice, language AS level FROM pred UNION ALL SELECT sentiment_class, y_pred, 'detail_level', detail_level FROM pred
    UNION ALL SELECT sentiment_class, y_pred, 'text', 'short' FROM pred WHERE length(text_feedback) <= 200 UNION ALL SELECT sentiment_class, y_pred, 'text', 'empty' FROM pred WHERE NOT {not_blank("text_feedback")}),
    {sql_classification("sl", "sentiment_class", "y_pred", "slice, level", min_rows=2)} SELECT DISTINCT slice, level, macro_f1, accuracy, n_samples FROM cls""",
)
def _k16(spark, sf):
    return evaluate.sensitivity(predictions(spark, sf), "sentiment_class", "y_pred", "text_feedback", ["language", "detail_level"], short=200)


_LANGS = ["de", "en", "es", "fr"]
SQL_LANGUAGE = f"""{SQL_CHAR_TERMS.format(k="survey_id", x="text_feedback", t="survey", lo=3, hi=3)},
  tc AS (SELECT term, sum(tf) AS total, {", ".join(f"coalesce(sum(tf) FILTER (WHERE language = '{l}'), 0) AS c_{l}" for l in _LANGS)} FROM terms JOIN survey ON survey_id = k WHERE survey_id % 5 <> 0 GROUP BY term),
  tt AS (SELECT count(*) AS v, {", ".join(f"sum(c_{l}) AS t_{l}" for l in _LANGS)} FROM tc),
  lp AS (SELECT term, {", ".join(f"ln((c_{l} + 1.0) / (t_{l} + v)) AS p_{l}" for l in _LANGS)} FROM tc, tt),
  ls AS (SELECT k, {", ".join(f"{r(f'sum(tf * p_{l})', 6)} AS s_{l}" for l in _LANGS)} FROM terms JOIN lp USING (term) GROUP BY k),
  lpred AS (SELECT survey_id, language, CASE WHEN s_de IS NULL THEN 'mixed' WHEN s_de = greatest(s_de, s_en, s_es, s_fr) THEN 'de' WHEN s_en = greatest(s_de, s_en, s_es, s_fr) THEN 'en' WHEN s_es = greatest(s_de, s_en, s_es, s_fr) THEN 'es' ELSE 'fr' END AS y_pred
    FROM survey LEFT JOIN ls ON k = survey_id WHERE survey_id % 5 = 0)"""


@query("k17_language_baseline", f"WITH {SQL_LANGUAGE}, {sql_classification('lpred', 'language', 'y_pred')} SELECT * FROM cls")
def _k17(spark, sf):
    docs = settle(survey(spark, sf).select("survey_id", "text_feedback", "language"), "docs")
    known, asked = docs.where("survey_id % 5 <> 0"), docs.where("survey_id % 5 = 0")
    profiles, languages = classify.language_profiles(spread(known), "language", "survey_id", "text_feedback")
    found = classify.detect_language(spread(asked), settle(profiles, "profiles"), languages, "survey_id", "text_feedback")
    return evaluate.classification_metrics(asked.join(found, "survey_id"), "language", "pred")


# --- projection, clusters, outliers ---------------------------------------------------------------------------------------------


def _planar(spark, sf):
    """Points that need no projection: two components of every embedding, scaled."""
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_idx"),
        (F.get(v, F.lit(0)).cast("double") * 10).alias("x"),
        (F.get(v, F.lit(1)).cast("double") * 10).alias("y"),
    )


SQL_PLANAR = "pts AS (SELECT vec_id AS row_idx, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings)"


@query("k18_text_projection")
def _k18(spark, sf):
    docs = survey(spark, sf).select("survey_id", "text_feedback", *LABELS)
    return embedding.project_texts(spread(docs), "survey_id", "text_feedback").points


@query("k18_vector_projection")
def _k18b(spark, sf):
    v = F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>"))
    rows = table(spark, sf, "embeddings").select("vec_id", v.alias("values"))
    places = F.when(F.size("values") > 0, F.sequence(F.lit(0), F.size("values") - 1)).otherwise(F.array().cast("array<int>"))
    size = rows.agg(F.max(F.size("values"))).first()[0] or 1
    return embedding.project(rows.select("vec_id", places.alias("indices"), "values"), "vec_id", size).points


@query("k18_model_projection")
def _k18c(spark, sf):
    docs, model = _fixed_model(spark, sf)
    root, snapshot = scratch_path(spark, "points"), versions.fingerprint(docs).first()["snapshot_id"]
    known = [root, snapshot, embedding.model_id(model), {"components": 2}]
    embedding.cached_points(spark, *known, lambda: embedding.project_by_model(model, docs, "survey_id").points)

    def again():
        raise AssertionError("the points were written before")

    return embedding.cached_points(spark, *known, again)


@query("k19_kmeans")
def _k19(spark, sf):
    return embedding.kmeans(settle(_planar(spark, sf), "points"), 4)[0].select("row_idx", "cluster")


@query(
    "k20_dbscan_core_points",
    f"WITH {SQL_PLANAR} SELECT a.row_idx, count(*) FILTER (WHERE (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 0.2::DOUBLE * 0.2::DOUBLE) >= 8 AS is_core FROM pts a, pts b GROUP BY a.row_idx",
)
def _k20(spark, sf):
    return density.dbscan_flags(_planar(spark, sf), "row_idx", 0.2, 8)


SQL_CLUSTERS = f"""WITH RECURSIVE {SQL_PLANAR}, near AS (SELECT a.row_idx AS a, b.row_idx AS b FROM pts a JOIN pts b ON (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 0.2::DOUBLE * 0.2::DOUBLE),
    core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 8), link AS (SELECT a, b FROM near SEMI JOIN core USING (a) WHERE b IN (SELECT a FROM core)),
    reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
    label AS (SELECT a, dense_rank() OVER (ORDER BY min(b)) - 1 AS cluster FROM reach GROUP BY a),
    found AS (SELECT p.row_idx, c.a IS NOT NULL AS is_core, coalesce(c.cluster, (SELECT min(l.cluster) FROM near n JOIN label l ON l.a = n.b WHERE n.a = p.row_idx), -1) AS cluster
      FROM pts p LEFT JOIN label c ON c.a = p.row_idx)"""


@query("k20_dbscan_clusters", f"{SQL_CLUSTERS} SELECT * FROM found")
def _k20b(spark, sf):
    return density.dbscan(_planar(spark, sf), "row_idx", 0.2, 8)


@query(
    "k21_local_outlier_factor",
    f"""WITH {SQL_PLANAR}, nn AS (SELECT a.row_idx AS q, b.row_idx AS o, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d,
    row_number() OVER (PARTITION BY a.row_idx ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.x, b.y) AS i FROM pts a JOIN pts b ON a.row_idx <> b.row_idx QUALIFY i <= 5),
    kd AS (SELECT q, max(d) AS kd FROM nn GROUP BY q), lrd AS (SELECT nn.q, 5 / (sum(greatest(d, kd)) + 1e-10::DOUBLE * 5) AS lrd FROM nn JOIN kd ON kd.q = nn.o GROUP BY nn.q)
    SELECT nn.q AS row_idx, {r("avg(o.lrd) / any_value(s.lrd)", 6)} AS outlier_score FROM nn JOIN lrd o ON o.q = nn.o JOIN lrd s ON s.q = nn.q GROUP BY nn.q""",
)
def _k21(spark, sf):
    scored = density.local_outlier_factor(_planar(spark, sf), "row_idx", 5)
    return scored.select("row_idx", rounded(F.col("outlier_score"), 6).alias("outlier_score"))


@query("k22_isolation_forest")
def _k22(spark, sf):
    return density.isolation_scores(_planar(spark, sf), "row_idx")


@query("k23_outlier_table")
def _k23(spark, sf):
    scored = density.isolation_scores(_planar(spark, sf), "row_idx")
    return embedding.flag_top_share(settle(scored, "scores"))


@query("k20_cluster_counts", f"{SQL_CLUSTERS} SELECT cluster, count(*) AS n FROM found GROUP BY cluster")
def _k20c(spark, sf):
    return embedding.cluster_table(_planar(spark, sf), "row_idx", "dbscan", eps=0.2, min_samples=8)[1]


@query(
    "k23_lof_table",
    f"""WITH {SQL_PLANAR}, nn AS (SELECT a.row_idx AS q, b.row_idx AS o, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d,
    row_number() OVER (PARTITION BY a.row_idx ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.x, b.y) AS i FROM pts a JOIN pts b ON a.row_idx <> b.row_idx QUALIFY i <= 20),
    kd AS (SELECT q, max(d) AS kd FROM nn GROUP BY q), lrd AS (SELECT nn.q, 20 / (sum(greatest(d, kd)) + 1e-10::DOUBLE * 20) AS lrd FROM nn JOIN kd ON kd.q = nn.o GROUP BY nn.q),
    lof AS (SELECT nn.q AS row_idx, avg(o.lrd) / any_value(s.lrd) AS score FROM nn JOIN lrd o ON o.q = nn.o JOIN lrd s ON s.q = nn.q GROUP BY nn.q)
    SELECT row_idx, {r("score", 6)} AS outlier_score, score > (SELECT quantile_cont(score, 0.9) FROM lof) AS is_outlier FROM lof""",
)
def _k23b(spark, sf):
    return embedding.outlier_table(_planar(spark, sf), "row_idx")[0].select("row_idx", "outlier_score", "is_outlier")


@query(
    "k24_external_encoder",
    f"""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
    c AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL), s AS (SELECT vec_id, c.label, sum(v * m) AS s FROM e JOIN c USING (i) GROUP BY ALL),
    p AS (SELECT vec_id, label, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS p FROM s)
    SELECT vec_id, CAST(arg_max(label, p) AS VARCHAR) AS pred, {r("max(p)")} AS conf FROM p GROUP BY vec_id""",
)
def _k24(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    cells = rows.select("label", F.posexplode("embedding").alias("i", "v"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m"))
    centres = sorted((c["label"], c["m"]) for c in means.collect())  # a vector per class
    weights = np.array([m for _, m in centres]).T

    def linear():
        return lambda vectors: np.array(vectors, float) @ weights

    scored = classify.external_scores(rows, "vec_id", "embedding", linear, [str(label) for label, _ in centres])
    return scored.select("vec_id", "pred", rounded(F.col("conf")).alias("conf"))


# --- versioned tables -----------------------------------------------------------------------------------------------------------------


def _text_table(spark, sf):
    return survey(spark, sf).select(
        F.col("survey_id").alias("row_idx"), "language", "detail_level", F.coalesce("sentiment_class", F.lit("")).alias("sentiment_class")
    )


@query(
    "o1_commit_version",
    "SELECT language, sentiment_class, count(*) AS n, (SELECT count(*) FROM survey) AS catalog_rows FROM (SELECT language, coalesce(sentiment_class, '') AS sentiment_class FROM survey) GROUP BY ALL",
)
def _o1(spark, sf):
    root = scratch_path(spark, "store")
    row = versions.commit(_text_table(spark, sf), root, "feedback", 1, "first")
    counted = row.select(F.col("n_rows").alias("catalog_rows"))
    frame = versions.read_version(spark, root, "feedback")
    return with_scalars(frame.groupBy("language", "sentiment_class").agg(F.count(F.lit(1)).alias("n")), counted)


@query(
    "o2_read_as_of",
    """SELECT 1 AS version, count(*) AS n FROM survey UNION ALL SELECT 2, count(*) FROM survey WHERE language <> 'en' UNION ALL SELECT 3, count(*) FROM survey WHERE language = 'fr'
    UNION ALL SELECT 4, count(*) FROM survey""",
)
def _o2(spark, sf):
    root = scratch_path(spark, "store")
    frame = _text_table(spark, sf)
    versions.commit(frame, root, "feedback", 1)
    versions.commit(frame.where("language <> 'en'"), root, "feedback", 2)
    versions.commit(frame.where("language = 'fr'"), root, "feedback", 3, branch="side")
    reads = [
        versions.read_version(spark, root, "feedback", version=1),
        versions.read_version(spark, root, "feedback", branch="main"),
        versions.read_version(spark, root, "feedback"),
    ]
    versions.move_head(spark, root, "feedback", 1)
    reads.append(versions.read_version(spark, root, "feedback", branch="main"))
    return union([f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i + 1).alias("version"), "n") for i, f in enumerate(reads)])


@query(
    "o3_edit_chain",
    """WITH base AS (SELECT survey_id AS row_idx, CASE WHEN survey_id % 10 = 3 THEN 'xx' ELSE language END AS language, detail_level, coalesce(sentiment_class, '') AS sentiment_class FROM survey),
    added AS (SELECT row_number() OVER (ORDER BY item_id) - 1 + (SELECT count(*) FROM survey) AS row_idx, 'en' AS language, '' AS detail_level, '' AS sentiment_class FROM benchmark),
    kept AS (SELECT * FROM (SELECT * FROM base UNION ALL SELECT * FROM added) WHERE row_idx % 4 <> 0)
    SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, language AS lang_code, detail_level, sentiment_class FROM kept""",
)
def _o3(spark, sf):
    base = _text_table(spark, sf)
    edits = base.where("row_idx % 10 = 3").select("row_idx", F.lit("language").alias("col"), F.lit("xx").alias("value"), F.lit(1).alias("seq"))
    from surveyloom.operators.ranks import dense_index

    added = dense_index(table(spark, sf, "benchmark").select("item_id", F.lit("en").alias("language")), "item_id")
    doomed = spark.range(0, base.count() + added.count(), 4).select(F.col("id").alias("row_idx"))
    chain = versions.edit_chain(base, edits, added, doomed, {"language": "lang_code"})
    root = scratch_path(spark, "store")
    for number, name in enumerate(chain, 1):
        versions.commit(chain[name], root, "feedback", number, name)
    return versions.read_version(spark, root, "feedback")


@query(
    "o7_parent_chains",
    """WITH RECURSIVE n AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations),
    up AS (SELECT n.id AS node, n.parent AS ancestor, 1 AS depth FROM n JOIN n p ON p.id = n.parent UNION ALL SELECT up.node, n.parent, depth + 1 FROM up JOIN n ON n.id = up.ancestor JOIN n p ON p.id = n.parent)
    SELECT node, ancestor, depth FROM up""",
)
def _o7(spark, sf):
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"),
    )
    return versions.lineage(turns, "id", "parent")


@query(
    "o7_ancestors_of_leaves",
    """WITH RECURSIVE n AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations),
    up AS (SELECT n.id AS node, n.parent AS ancestor, 1 AS depth FROM n JOIN n p ON p.id = n.parent WHERE n.id NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL)
    UNION ALL SELECT up.node, n.parent, depth + 1 FROM up JOIN n ON n.id = up.ancestor JOIN n p ON p.id = n.parent)
    SELECT node, ancestor, depth FROM up""",
)
def _o7_leaves(spark, sf):
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"),
    )
    leaves = turns.join(turns.select(F.col("parent").alias("id")), "id", "left_anti")
    return versions.ancestors(turns, leaves, "id", "parent")


@query(
    "o8_subset_dataset",
    "SELECT 'subset' AS tag, language, detail_level, count(*) AS n FROM survey WHERE language IN ('de', 'fr') GROUP BY ALL",
)
def _o8(spark, sf):
    root = scratch_path(spark, "store")
    versions.commit(_text_table(spark, sf), root, "feedback", 1)
    chosen = subset(versions.read_version(spark, root, "feedback"), {"column_in": {"language": ["de", "fr"]}}, require_rows=True)
    versions.commit(chosen, root, "feedback_subset", 1, "subset")
    frame = versions.read_version(spark, root, "feedback_subset")
    return frame.groupBy(F.lit("subset").alias("tag"), "language", "detail_level").agg(F.count(F.lit(1)).alias("n"))


# --- jobs --------------------------------------------------------------------------------------------------------------------------------


@query("r1_full_run")
def _r1(spark, sf):
    return jobs.full_run(survey(spark, sf), output=scratch_path(spark, "run"))


@query("r2_score_and_store")
def _r2(spark, sf):
    frame = survey(spark, sf).withColumnRenamed("survey_id", "row_idx")
    scored, _ = jobs.score_and_store(frame, _two_models(spark, sf), scratch_path(spark, "analysis"))
    return scored.select("row_idx", *[c for c in scored.columns if c.endswith(("_pred", "_conf"))])


_RULES = [{"col": "language", "op": "ne", "val": "EN"}, {"col": "survey_id", "op": "gte", "val": "100"}]
_R3 = ["item_1", "item_4", "text_feedback", "language", "detail_level"]


@query(
    "r3_dataset_descriptive",
    "WITH fs AS (SELECT * FROM survey WHERE lower(language) <> 'en' AND survey_id >= 100), " + sql_descriptive(["item_1", "item_4"], ["text_feedback", "language", "detail_level"], "fs")[5:],
)
def _r3(spark, sf):
    return jobs.dataset_analytics(survey(spark, sf), "survey_id", _R3, _RULES)


@query(
    "r3_dataset_associations",
    f"WITH fs AS (SELECT * FROM survey WHERE lower(language) <> 'en' AND survey_id >= 100) {sql_pearson('item_1', 'item_4', 'fs')} UNION ALL {sql_pearson('item_1', 'item_9', 'fs')} UNION ALL {sql_pearson('item_4', 'item_9', 'fs')} UNION ALL {sql_cramers('language', 'detail_level', 'fs')}",
)
def _r3b(spark, sf):
    columns = ["item_1", "item_4", "item_9", "language", "detail_level"]
    return jobs.dataset_analytics(survey(spark, sf), "survey_id", columns, _RULES, kind="associations")


def sql_rows(source: str, section: str, name: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {name} AS name, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}" for m in metrics
    )


@query(
    "r4_result_diagnostics",
    f"""WITH rs AS (SELECT * FROM results WHERE sentiment_conf >= 0.2 AND contains(lower(text_feedback), 'th')), {sql_classification("rs", "sentiment_class", "sentiment_pred", digits=4)},
    {sql_calibration("rs", "sentiment_class", "sentiment_pred", "sentiment_conf")} {sql_rows("cls", "diagnostics", "label", ["support", "precision", "recall", "f1", "accuracy", "macro_f1"])}
    UNION ALL {sql_rows("cal", "calibration", "CAST(bin AS VARCHAR)", ["count", "avg_confidence", "accuracy", "ece"])}""",
)
def _r4(spark, sf):
    rules = [{"col": "sentiment_conf", "op": "gte", "val": "0.2"}, {"col": "text_feedback", "op": "contains", "val": "TH"}]
    return jobs.result_diagnostics(results(spark, sf), "sentiment_class", "sentiment_pred", "sentiment_conf", rules)


@query(
    "r4_result_associations",
    f"WITH rs AS (SELECT * FROM results WHERE sentiment_conf >= 0.2) {sql_pearson('item_1', 'sentiment_conf', 'rs')} UNION ALL {sql_cramers('sentiment_class', 'sentiment_pred', 'rs')}",
)
def _r4b(spark, sf):
    rules = [{"col": "sentiment_conf", "op": "gte", "val": "0.2"}]
    columns = ["item_1", "sentiment_class", "sentiment_pred", "sentiment_conf"]
    return jobs.dataset_analytics(results(spark, sf), "row_idx", columns, rules, kind="associations")


@query("r5_embedding_analytics")
def _r5(spark, sf):
    docs = spread(survey(spark, sf).select("survey_id", "text_feedback", *LABELS))
    points = embedding.project_texts(docs, "survey_id", "text_feedback").points
    return jobs.embedding_analytics(points.select("survey_id", "x", "y"), "survey_id", eps=0.02)


@query(
    "r6_compare_two_runs",
    f"""WITH {SQL_RUNS}, j AS (SELECT coalesce(a.label, b.label) AS label, coalesce(a.s, 0) AS share_1, coalesce(b.s, 0) AS share_2 FROM {_share("run0")} a FULL JOIN {_share("run2")} b ON a.label = b.label),
    dl AS (SELECT *, {r("share_2 - share_1")} AS delta FROM j), t AS (SELECT {r("avg(CASE WHEN a.sentiment_pred <> b.sentiment_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS rate FROM run0 a JOIN run2 b USING (row_idx))
    {sql_rows("dl", "shares", "'sentiment/' || label", ["share_1", "share_2", "delta"])} UNION ALL SELECT 'disagreement', 'sentiment', 'rate', rate FROM t UNION ALL SELECT 'disagreement', 'overall', 'rate', {r("rate")} FROM t""",
)
def _r6(spark, sf):
    return jobs.compare_runs(_run(spark, sf, 0), _run(spark, sf, 2), {"sentiment": "sentiment_pred"})


@query(
    "r6_cross_compare",
    f"""WITH {SQL_RUNS}, j AS (SELECT a.sentiment_pred = b.sentiment_pred AND b.sentiment_pred = c.sentiment_pred AS same FROM run0 a JOIN run1 b USING (row_idx) JOIN run2 c USING (row_idx))
    SELECT 'counts' AS section, '0/sentiment_pred/' || sentiment_pred AS name, 'count' AS metric, count(*)::DOUBLE AS value FROM run0 GROUP BY ALL
    UNION ALL SELECT 'counts', '1/sentiment_pred/' || sentiment_pred, 'count', count(*)::DOUBLE FROM run1 GROUP BY ALL
    UNION ALL SELECT 'counts', '2/sentiment_pred/' || sentiment_pred, 'count', count(*)::DOUBLE FROM run2 GROUP BY ALL
    UNION ALL SELECT 'disagreement', 'sentiment_pred', 'rate', {r("avg(CASE WHEN same THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)")} FROM j""",
)
def _r6b(spark, sf):
    return jobs.cross_compare([_run(spark, sf, i) for i in range(3)], ["sentiment_pred"])


@query(
    "r7_run_metrics",
    f"""WITH {SQL_LOADINGS}, {SQL_FLAGS}, om AS (SELECT factor, sum(loading) AS s, sum(1.0 - loading * loading) AS u FROM ld GROUP BY 1), al AS ({" UNION ALL ".join(_alpha_sql(*s) for s in _FULL + _LEFT)}),
    {sql_classification("pred", "sentiment_class", "y_pred")},
    rt AS (SELECT dimension, level, count(*) AS n, count(*) FILTER (WHERE hit) AS n_flagged, {r("avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", 6)} AS rate FROM ({SQL_RATES}) GROUP BY ALL)
    SELECT 'psychometrics' AS section, factor || '/' || dropped AS name, CASE WHEN dropped = '' THEN 'alpha' ELSE 'alpha_if_deleted' END AS metric, alpha AS value FROM al
    UNION ALL SELECT 'psychometrics', factor || '/', 'omega', {r("greatest(0.0, least(1.0, s * s / (s * s + u)))", 6)} FROM om
    UNION ALL {sql_rows("cls", "classification", "label", ["support", "precision", "recall", "f1", "accuracy", "macro_f1"])}
    UNION ALL {sql_rows("rt", "contradiction", "dimension || '/' || level", ["n", "n_flagged", "rate"])}""",
)
def _r7(spark, sf):
    flags, _ = _flags(spark, sf)
    table_of_run = jobs.run_metrics(survey(spark, sf), predictions(spark, sf), "sentiment_class", "y_pred", _loadings(spark, sf), settle(flags, "flags"))
    return table_of_run.withColumn("value", rounded(F.col("value"), 6))
