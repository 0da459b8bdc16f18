"""Linear text classifiers: training, scoring, explanation, warm start, comparison.

A fitted model is a table of term weights plus a few numbers, so scoring and explaining are joins and sums.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from surveyloom.functions.numbers import rounded, softmax
from surveyloom.functions.text import PREPROCESS_SPEC_ID, is_blank, normalize_text, preprocess, redact
from surveyloom.operators.evaluate import classification_metrics
from surveyloom.operators.features import (
    TERM_FAMILIES,
    join_terms,
    most_frequent,
    sparse_rows,
    term_bags,
    tfidf,
    tfidf_bags,
    vectors,
    numbered_terms,
    with_idf,
)
from surveyloom.operators.predicates import trainable_rows
from surveyloom.operators.profile import class_inflation, shares, training_profile
from surveyloom.operators.ranks import top_per_group
from surveyloom.operators.sampling import oversample, stratified_split
from surveyloom.operators.schema import TEXT_NAMES, Roles, canonical, resolve_roles
from surveyloom.operators.scoring import TermTable, by_place, count_logits, count_vectors, counted_terms, local_counts, local_logits, predicted, term_table
from surveyloom.session import packed, release, settle, settle_at, settled_bytes, side_by_side

# Vocabulary caps of the two feature families, and the label column of each task.
MAX_FEATURES = {"tfidf": 50_000, "char_ngram": 100_000}
TASKS = {"language": "language", "sentiment": "sentiment_class", "detail_level": "detail_level"}


#: Tables of weights in use; one goes with the frame it was made from.
_TABLES: WeakKeyDictionary[DataFrame, TermTable | None] = WeakKeyDictionary()


@dataclass
class TextModel:
    """Term weights (term, idx, idf, w: one weight per class), intercepts, classes, and what the model expects."""

    name: str
    task: str
    family: str
    classes: list[str]
    weights: DataFrame
    intercepts: list[float]
    max_features: int
    text_column: str = "text_processed"
    preprocess_spec: str | None = PREPROCESS_SPEC_ID
    metrics: dict = field(default_factory=dict)

    def terms(self, df: DataFrame, key: str) -> DataFrame:
        return TERM_FAMILIES[self.family](df, key, self.text_column)

    def table(self) -> TermTable | None:
        """The weights as a table for row-local scoring, fetched once; None where they are too large for it."""
        if self.weights not in _TABLES:
            _TABLES[self.weights] = term_table(self.weights, len(self.classes))
        return _TABLES[self.weights]

    def save(self, path: str) -> None:
        """Weights as parquet, the rest as one row of JSON."""
        self.weights.write.parquet(f"{path}/weights")
        about = {k: getattr(self, k) for k in ABOUT}
        spark = self.weights.sparkSession
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return TextModel(weights=spark.read.parquet(f"{path}/weights"), **about)


ABOUT = ["name", "task", "family", "classes", "intercepts", "max_features", "text_column", "preprocess_spec", "metrics"]


@dataclass
class TrainingRows:
    """What fits on the same texts share: the vocabulary with idf, and the rows with their labels, both written once because training reads them often.

    Rows hold how often each known term occurs and become weights as they are read; without ``table`` (a vocabulary too large to broadcast) they hold weights.
    """

    vocab: DataFrame
    rows: DataFrame
    table: TermTable | None
    size: int

    def vectors(self, *keep: Column) -> DataFrame:
        if self.table is None:
            return vectors(self.rows, self.size, *keep)
        return count_vectors(self.rows.select(*keep, "indices", "counts"), self.table, self.size)


def _training_rows(df: DataFrame, key: str, text: str, labels: list[str], family: str, max_features: int) -> TrainingRows:
    """Terms are merged per text before they are counted, and rows are made inside their own row from the capped vocabulary, so only (term, counts) are
    shuffled. A vocabulary too large to broadcast takes the join.
    """
    documents = df.select(key, text, *dict.fromkeys(labels))
    counts = settle(counted_terms(documents, text, family), "term-counts")
    vocab = settle(with_idf(numbered_terms(counts, max_features), documents), "vocabulary")
    release(counts)
    table = term_table(vocab)
    if table is not None:
        rows = local_counts(documents, text, family, table).drop(text)
    else:
        rows = sparse_rows(tfidf(TERM_FAMILIES[family](documents, key, text), vocab, key, max_features), documents, key).join(documents.drop(text), key)
    return TrainingRows(vocab, settle(rows, "rows"), table, vocab.count())


def _weight_table(vocab: DataFrame, coefficients: np.ndarray) -> DataFrame:
    """Attach one weight per class to each vocabulary term; the matrix is classes x capped vocabulary and goes to the tasks as one block of numbers."""
    shared = vocab.sparkSession.sparkContext.broadcast(np.ascontiguousarray(coefficients.T))
    terms = vocab.select("idx", "term", "df", "total", "idf")
    out = StructType([*terms.schema.fields, *StructType.fromDDL("w array<double>").fields])

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value[batch.column(0).to_numpy()]
            w = pa.ListArray.from_arrays(pa.array((np.arange(len(found) + 1) * found.shape[1]).astype(np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, w], names=out.names)

    return settle(terms.mapInArrow(attach, out), "weights")


def _class_weights(rows: DataFrame, label: str, balanced: bool) -> tuple[list[str], list[float], int]:
    """Classes in order, the row weight of each, and the number of rows. One row per class reaches the driver."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(counts)
    n = sum(counts.values())
    return classes, [n / (len(classes) * counts[c]) if balanced else 1.0 for c in classes], n


def _class_number(classes: list[str], label: str) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("double")


def train_classifier(
    df: DataFrame,
    task: str,
    label: str,
    family: str = "tfidf",
    key: str = "survey_id",
    text: str = "text_processed",
    max_features: int | None = None,
    C: float = 1.0,
    max_iter: int = 1000,
    tol: float = 1e-3,
    balanced: bool = True,
    name: str | None = None,
) -> TextModel:
    """L2-penalised multinomial logistic regression on TF-IDF.

    The penalty is 1 / (C * sum of row weights), and features are not rescaled, which is the usual C parametrisation.
    """
    cap = max_features or MAX_FEATURES[family]
    made = _training_rows(df, key, text, [label], family, cap)
    try:
        return _fit(made, task, label, family, text, cap, C, max_iter, tol, balanced, name)
    finally:
        release(made.rows)


def _fit(
    made: TrainingRows, task: str, label: str, family: str, text: str, cap: int, C: float = 1.0, max_iter: int = 1000, tol: float = 1e-3, balanced: bool = True, name: str | None = None
) -> TextModel:
    """The regression of :func:`train_classifier` on rows that are made; they may serve further fits."""
    classes, weights, n = _class_weights(made.rows, label, balanced)
    if len(classes) < 2:
        raise ValueError(f"{task} needs at least two classes")
    number = _class_number(classes, label)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number + 1).cast("int"))
    data = packed(made.vectors(number.alias("_class"), weight.alias("_weight")), n)
    fitted = LogisticRegression(
        featuresCol="features",
        labelCol="_class",
        weightCol="_weight",
        family="multinomial",
        regParam=1.0 / (C * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    ).fit(data)
    return TextModel(
        name=name or f"{task}_{family}",
        task=task,
        family=family,
        classes=classes,
        weights=_weight_table(made.vocab, fitted.coefficientMatrix.toArray()),
        intercepts=[float(v) for v in fitted.interceptVector],
        max_features=cap,
        text_column=text,
    )


def logits(model: TextModel, df: DataFrame, key: str) -> DataFrame:
    """(key, logits) of every row: weights times unit-length TF-IDF, summed per document in one aggregate."""
    raw = _raw_entries(model, df, key)
    sums = raw.groupBy(key).agg(
        F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_length"),
        *[F.sum(F.col("_raw") * F.col("w")[i]).alias(f"_s{i}") for i in range(len(model.classes))],
    )
    score = [
        F.lit(b) + F.coalesce(F.try_divide(F.col(f"_s{i}"), F.col("_length")), F.lit(0.0))
        for i, b in enumerate(model.intercepts)
    ]
    return df.select(key).join(sums, key, "left").select(key, F.array(*score).alias("logits"))


def _raw_entries(model: TextModel, df: DataFrame, key: str) -> DataFrame:
    joined = join_terms(model.terms(df, key), model.weights.select("term", "idf", "w"), model.max_features)
    return joined.withColumn("_raw", (F.log("tf") + 1.0) * F.col("idf"))


def predict(model: TextModel, df: DataFrame, key: str = "survey_id") -> DataFrame:
    """(key, pred, conf, probabilities): the most likely class, its probability, and all of them in class order.

    Row-local while the weights may be broadcast, else by joins of terms and weights.
    """
    if model.table() is not None:
        return predict_rows(model, df).select(key, "pred", "conf", "probabilities")
    return predict_by_join(model, df, key)


def predict_rows(model: TextModel, df: DataFrame) -> DataFrame:
    """Adds pred, conf and probabilities to a batch or streaming frame without a shuffle."""
    table = model.table()
    if table is None:
        raise ValueError(f"{model.name}: the weights are too large to broadcast")
    found = df.withColumn("_logits", local_logits(df, F.col(model.text_column), model.family, table, model.intercepts))
    return found.withColumns(predicted(F.col("_logits"), model.classes)).drop("_logits")


def predict_by_join(model: TextModel, df: DataFrame, key: str = "survey_id") -> DataFrame:
    return logits(model, df, key).withColumns(predicted(F.col("logits"), model.classes)).drop("logits")


def global_importance(model: TextModel, top_n: int = 20) -> DataFrame:
    """The terms with the largest weight for each class."""
    return top_weights(class_weights(model.weights, model.classes), top_n)


def class_weights(weights: DataFrame, classes: list[str]) -> DataFrame:
    """(class, term, weight) rows. A table with one weight for two classes is mirrored."""
    names = F.array(*[F.lit(c) for c in classes])
    w = F.when(F.size("w") == 1, F.array(-F.col("w")[0], F.col("w")[0])).otherwise(F.col("w"))
    cells = F.zip_with(names, w, lambda c, v: F.struct(c.alias("class"), v.alias("weight")))
    return weights.select("term", F.inline(cells))


def top_weights(weights: DataFrame, top_n: int) -> DataFrame:
    ranked = top_per_group(weights, ["class"], [F.desc("weight"), F.asc("term")], top_n)
    return ranked.select("class", "rank", F.col("term").alias("feature"), rounded(F.col("weight"), 6).alias("weight"))


def local_contributions(entries: DataFrame, weights: DataFrame, predicted: DataFrame | None, key: str, top_n: int = 10) -> DataFrame:
    """Top terms of every row by |value x weight of the predicted class|, for the whole table at once.

    ``entries`` is (key, term, value), ``weights`` (class, term, weight), ``predicted`` (key, pred); without it ``entries`` carry ``pred``.
    """
    # all classes' weights of a term are one row, so a term that one class uses everywhere is spread like any other
    by_term = settle(weights.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("class", "weight"))).alias("_weights")), "term-weights")
    placed = entries if predicted is None else entries.join(predicted.select(key, "pred"), key)
    joined = join_terms(placed.withColumnRenamed("pred", "class"), by_term)
    joined = joined.withColumn("weight", F.try_element_at("_weights", F.col("class"))).where(F.col("weight").isNotNull())
    scored = joined.withColumn("contribution", F.col("value") * F.col("weight"))
    ranked = top_per_group(scored, [key], [F.desc(F.abs("contribution")), F.asc("term")], top_n)
    return ranked.select(
        key,
        "rank",
        F.col("term").alias("feature"),
        rounded(F.col("value"), 6).alias("value"),
        rounded(F.col("weight"), 6).alias("weight"),
        rounded(F.col("contribution"), 6).alias("contribution"),
    )


def explain_rows(model: TextModel, df: DataFrame, key: str = "survey_id", top_n: int = 10) -> DataFrame:
    scored = predict_rows(model, df) if model.table() is not None else df.join(predict(model, df, key), key)
    bags = tfidf_bags(scored, key, model.text_column, model.family, model.weights, model.max_features, keep=("pred",))
    entries = bags.select(key, "pred", F.inline("entries")).select(key, "pred", "term", F.col("weight").alias("value"))
    return local_contributions(entries, class_weights(model.weights, model.classes), None, key, top_n)


def _descend(
    cost: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, max_iter: int, tol: float, memory: int = 8, flat: float = 1e-4
) -> tuple[np.ndarray, bool, int]:
    """Limited-memory quasi-Newton steps until the gradient is ``tol`` of the first one, or ``flat`` as it stands: a start may be the optimum.

    Each step costs one pass, or a few where it must be shortened.
    """
    value, gradient = cost(theta)
    first = np.sqrt((gradient**2).sum())
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for step in range(max_iter):
        if np.sqrt((gradient**2).sum()) <= max(tol * first, min(tol, flat)):
            return theta, True, step
        direction, kept = gradient.copy(), []
        for moved, change, inverse in reversed(pairs):
            share = inverse * (moved * direction).sum()
            kept.append(share)
            direction -= share * change
        if pairs:
            moved, change, inverse = pairs[-1]
            direction /= inverse * (change**2).sum()
        else:
            direction /= max(1.0, first)
        for (moved, change, inverse), share in zip(pairs, reversed(kept), strict=True):
            direction += (share - inverse * (change * direction).sum()) * moved
        slope, length = (gradient * direction).sum(), 1.0
        while True:
            tried = theta - length * direction
            new_value, new_gradient = cost(tried)
            if new_value <= value - 1e-4 * length * slope or length < 1e-6:
                break
            length /= 2
        if length < 1e-6:
            return theta, False, step
        moved, change = tried - theta, new_gradient - gradient
        if (moved * change).sum() > 1e-12:
            pairs = [*pairs, (moved, change, 1.0 / (moved * change).sum())][-memory:]
        theta, value, gradient = tried, new_value, new_gradient
    return theta, False, max_iter


def warm_start(
    base: TextModel,
    df: DataFrame,
    label: str,
    key: str = "survey_id",
    C: float = 1.0,
    max_iter: int = 1000,
    tol: float = 1e-3,
    balanced: bool = True,
) -> TextModel | None:
    """Continue from another model's weights on new rows; None when the classes differ.

    Weights carry over by term. Each step is one pass over the rows: a task adds up its part of loss and
    gradient, and the parts, each classes x capped vocabulary, are summed in two stages. Steps end when the gradient has shrunk to ``tol`` of the
    first one, or is flat; ``metrics`` says whether that was reached within ``max_iter``.
    """
    made = _training_rows(df, key, base.text_column, [label], base.family, base.max_features)
    vocab = made.vocab
    classes, weights, n = _class_weights(made.rows, label, balanced)
    if classes != base.classes:
        release(made.rows)
        return None
    k, size = len(classes), made.size
    start = vocab.select("term", "idx").join(base.weights.select("term", "w"), "term").select("idx", "w").toPandas()
    theta = np.zeros((k, size + 1))
    if len(start):
        theta[:, start["idx"].to_numpy()] = np.array(start["w"].tolist()).T
    theta[:, size] = base.intercepts
    penalty = 1.0 / (C * n)
    spark = df.sparkSession
    content = "values" if made.table is None else "counts"
    data = packed(made.rows.select(_class_number(classes, label).cast("int").alias("y"), "indices", content), n)
    idf = None if made.table is None else spark.sparkContext.broadcast(by_place(made.table, made.table.idf))
    row_weight = np.array(weights)

    def cost(at: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and its gradient: one pass over the rows."""
        shipped = spark.sparkContext.broadcast(at)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w = shipped.value
            loss, gradient = 0.0, np.zeros_like(w)
            for pdf in batches:
                if not len(pdf):
                    continue
                y = pdf["y"].to_numpy()
                row = np.repeat(np.arange(len(pdf)), pdf["indices"].map(len).to_numpy())
                indices, values = (np.concatenate(pdf[c].to_list()) for c in ("indices", content))
                indices = indices.astype(np.int64)
                if idf is not None:
                    values = (np.log(values) + 1.0) * idf.value[indices]
                    values = values / np.sqrt(np.bincount(row, values * values, len(pdf)))[row]
                z = np.stack([np.bincount(row, c[indices] * values, len(pdf)) + c[-1] for c in w], axis=1)
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                total = p.sum(axis=1, keepdims=True)
                place = np.arange(len(y))
                loss += float((row_weight[y] * (np.log(total[:, 0]) - z[place, y])).sum())
                p /= total
                p[place, y] -= 1.0
                p *= row_weight[y][:, None]
                for c in range(len(w)):
                    gradient[c, :-1] += np.bincount(indices, p[row, c] * values, w.shape[1] - 1)
                gradient[:, -1] += p.sum(axis=0)
            yield pd.DataFrame({"g": [np.append(gradient.ravel(), loss)]})

        parts = data.mapInPandas(part, "g array<double>").select(
            array_to_vector("g").alias("g"), F.pmod(F.spark_partition_id(), F.lit(32)).alias("stage")
        )
        staged = parts.groupBy("stage").agg(Summarizer.sum(F.col("g")).alias("g"))
        found = staged.agg(Summarizer.sum(F.col("g")).alias("g")).first()["g"].toArray() / n
        shipped.destroy()
        gradient = found[:-1].reshape(at.shape)
        gradient[:, :-1] += penalty * at[:, :-1]
        return float(found[-1] + penalty / 2 * (at[:, :-1] ** 2).sum()), gradient

    theta, converged, steps = _descend(cost, theta, max_iter, tol)
    release(made.rows)
    return TextModel(
        name=f"{base.name}_warm",
        task=base.task,
        family=base.family,
        classes=classes,
        weights=_weight_table(vocab, theta[:, :-1]),
        intercepts=theta[:, -1].tolist(),
        metrics={"converged": converged, "steps": steps},
        max_features=base.max_features,
        text_column=base.text_column,
        preprocess_spec=base.preprocess_spec,
    )


def scored_rows(model: TextModel, df: DataFrame, label: str, key: str = "survey_id") -> DataFrame:
    if model.table() is not None:
        return predict_rows(model, df).drop("probabilities").withColumn("y_true", F.col(label))
    return df.join(predict(model, df, key).select(key, "pred", "conf"), key).withColumn("y_true", F.col(label))


def model_metrics(model: TextModel, df: DataFrame, label: str, key: str = "survey_id") -> DataFrame:
    return classification_metrics(scored_rows(model, df, label, key), "y_true", "pred")


def compare_models(base: TextModel, new: TextModel, test: DataFrame, label: str, key: str = "survey_id") -> DataFrame:
    """Per-class and overall metrics of two models on the same rows, and the change, four decimals."""
    names = ["precision", "recall", "f1", "accuracy", "macro_f1"]

    def side(model: TextModel, tag: str) -> DataFrame:
        return model_metrics(model, test, label, key).select("label", *[F.col(m).alias(f"{tag}_{m}") for m in names])

    joined = side(base, "base").join(side(new, "new"), "label", "full_outer").fillna(0.0)
    return joined.select(
        "label",
        *[rounded(F.col(f"{t}_{m}")).alias(f"{t}_{m}") for m in names for t in ("base", "new")],
        *[rounded(F.col(f"new_{m}") - F.col(f"base_{m}")).alias(f"delta_{m}") for m in names],
    )


def train_task(
    train: DataFrame, val: DataFrame, task: str, family: str, key: str = "survey_id", text: str = "text_processed", **options
) -> tuple[TextModel, DataFrame]:
    """One classifier and its report: (split, label, metric, value) with metrics, predicted shares and inflation flag."""
    return train_tasks(train, val, (task,), family, key, text, **options)[0]


#: Bytes of stored training rows up to which fits run side by side; each keeps its own copy of the rows, several times as large, in memory or on disk.
SIDE_BY_SIDE_BYTES = 32 << 20


def train_tasks(
    train: DataFrame, val: DataFrame, tasks: Iterable[str], family: str, key: str = "survey_id", text: str = "text_processed", max_features: int | None = None, **options
) -> list[tuple[TextModel, DataFrame]]:
    """:func:`train_task` for several tasks. They differ in the label alone, so the texts' terms are counted, stored and read for scoring once for all of them."""
    tasks, cap = list(tasks), max_features or MAX_FEATURES[family]
    labels = list(dict.fromkeys(TASKS[t] for t in tasks))
    known = [d.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in labels}) for d in (train, val)]
    made = _training_rows(known[0], key, text, labels, family, cap)
    workers = 4 if settled_bytes(made.rows) <= SIDE_BY_SIDE_BYTES else 1
    models = side_by_side([lambda t=t: _fit(made, t, TASKS[t], family, text, cap, **options) for t in tasks], workers)
    scored = [_scored_together(models, made, d, key, own) for d, own in zip(known, (True, False), strict=True)]
    release(made.rows)
    return [(m, _task_report(m, *[s.select(key, F.col(TASKS[t]).alias("y_true"), F.col(f"_pred_{i}").alias("pred"), F.col(f"_conf_{i}").alias("conf")) for s in scored])) for i, (t, m) in enumerate(zip(tasks, models, strict=True))]


def _scored_together(models: list[TextModel], made: TrainingRows, df: DataFrame, key: str, own: bool) -> DataFrame:
    """(key, labels, _pred_i, _conf_i of model i), written once. The models come from the rows ``made``; ``own``: so do the rows of ``df``."""
    labels = list(dict.fromkeys(TASKS[m.task] for m in models))
    tables = [m.table() for m in models]
    if made.table is None or any(t is None for t in tables):
        for i, m in enumerate(models):
            one = predict(m, df, key).select(key, F.col("pred").alias(f"_pred_{i}"), F.col("conf").alias(f"_conf_{i}"))
            df = df.join(one, key)
        return settle(df.select(key, *labels, *[f"_{c}_{i}" for i in range(len(models)) for c in ("pred", "conf")]), "scored")
    # one vocabulary, so the weights of all models are columns of one table
    together = TermTable(made.table.terms, made.table.places, made.table.idf, np.hstack([by_place(t, t.weights)[made.table.places] for t in tables]))
    rows = made.rows if own else local_counts(df.select(key, models[0].text_column, *labels), models[0].text_column, models[0].family, together)
    found = count_logits(rows.select(key, *labels, "indices", "counts"), together, [b for m in models for b in m.intercepts])
    at, columns = 1, []
    for i, m in enumerate(models):
        chosen = predicted(F.slice("logits", at, len(m.classes)), m.classes)
        columns += [chosen[c].alias(f"_{c}_{i}") for c in ("pred", "conf")]
        at += len(m.classes)
    return settle(found.select(key, *labels, *columns), "scored")


def _task_report(model: TextModel, train: DataFrame, val: DataFrame) -> DataFrame:
    parts = []
    for split, scored in (("train", train), ("val", val)):
        metrics = classification_metrics(scored, "y_true", "pred")
        names = ["support", "precision", "recall", "f1", "accuracy", "macro_f1", "n_samples"]
        parts.append(_metric_rows(metrics, split, names))
        if split == "val":
            parts.append(_metric_rows(shares(scored, "pred"), split, ["share"]))
            inflation = class_inflation(scored, "pred").withColumn("label", F.lit("neutral"))
            parts.append(_metric_rows(inflation.withColumn("inflated", F.col("inflated").cast("double")), split, ["inflated"]))
    report = reduce(DataFrame.unionByName, parts)
    return report.select(F.lit(model.task).alias("task"), F.lit(model.family).alias("family"), "*")


def _metric_rows(df: DataFrame, split: str, names: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    return df.select(F.lit(split).alias("split"), "label", F.inline(cells))


def train_all(
    train: DataFrame, val: DataFrame, tasks: Iterable[str] = tuple(TASKS), families: Iterable[str] = ("tfidf", "char_ngram"), **options
) -> tuple[dict[tuple[str, str], TextModel], DataFrame]:
    """Every task with every feature family, on one stored frame. The families follow one another, so only one family's rows are kept at a time."""
    tasks = list(tasks)
    done = {(t, f): made for f in families for t, made in zip(tasks, train_tasks(train, val, tasks, f, **options), strict=True)}
    return {pair: model for pair, (model, _) in done.items()}, reduce(DataFrame.unionByName, [report for _, report in done.values()])


def incompatibilities(model: TextModel, df: DataFrame, roles: Roles, assigned: bool = False) -> list[str]:
    """Why a model cannot score a table; empty when it can."""
    reasons = []
    if roles.text is None:
        reasons.append("missing_required_role: no text column")
    elif roles.text not in df.columns:
        reasons.append(f"missing_column: {roles.text}")
    elif not assigned and canonical(roles.text) not in TEXT_NAMES:
        reasons.append(f"missing_required_role: {roles.text} only matched as the first text column")
    if model.preprocess_spec not in (None, PREPROCESS_SPEC_ID):
        reasons.append(f"unsupported_preprocess_spec: {model.preprocess_spec}")
    return reasons


def score_table(
    df: DataFrame,
    models: list[TextModel],
    key: str = "row_idx",
    stored: dict[str, str] | None = None,
    overrides: dict[str, str] | None = None,
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Apply many models to a table: <task>_<name>_pred and _conf columns, and one summary row per model and class.

    Texts are cleaned once. All models whose weights may be broadcast score in one pass over the rows, written once; others are joined on ``key``. A
    model that does not fit is listed with its reasons and the others go on. With ``path`` the scored table is written there, else to the shared folder.
    """
    roles = resolve_roles(df, stored, overrides)
    assigned = bool(overrides and "text" in overrides) or "text" in (stored or {}).values()
    reasons = {id(m): incompatibilities(m, df, roles, assigned) for m in models}
    fitting = [m for m in models if not reasons[id(m)]]
    out, prefix = df, {id(m): f"{m.task}_{m.name[:8]}" for m in models}
    if fitting:
        out = df.withColumn("_clean", redact(normalize_text(F.col(roles.text)))) if any(m.preprocess_spec for m in fitting) else df
        if any(m.table() is None for m in fitting):  # joins read the texts again
            out = settle(out, "cleaned")
        texts = {id(m): F.coalesce(F.col("_clean" if m.preprocess_spec else roles.text), F.lit("")) for m in fitting}
        scored = out
        for m in fitting:
            if m.table() is not None:
                scored = scored.withColumn(f"_of_{prefix[id(m)]}", local_logits(out, texts[id(m)], m.family, m.table(), m.intercepts))
        for m in fitting:
            p = prefix[id(m)]
            if m.table() is not None:
                found = predicted(F.col(f"_of_{p}"), m.classes)
                scored = scored.withColumns({f"{p}_pred": found["pred"], f"{p}_conf": found["conf"]}).drop(f"_of_{p}")
        for m in fitting:
            if m.table() is None:
                rows = out.select(key, texts[id(m)].alias(m.text_column))
                columns = [F.col(c).alias(f"{prefix[id(m)]}_{c}") for c in ("pred", "conf")]
                scored = scored.join(predict_by_join(m, rows, key).select(key, *columns), key, "left")
        cleaned, out = out, scored.drop("_clean")
        out = settle(out, "scored") if path is None else settle_at(out, path)
        release(cleaned)
    elif path is not None:
        out = settle_at(out, path)
    summaries = []
    for m in models:
        if reasons[id(m)]:
            summaries.append(_summary(df.sparkSession, m, "; ".join(reasons[id(m)])))
            continue
        about = [F.lit(m.name).alias("model"), F.lit(m.task).alias("task"), F.lit(None).cast("string").alias("error")]
        found = shares(out.withColumnRenamed(f"{prefix[id(m)]}_pred", "pred"), "pred")
        summaries.append(found.select(*about, F.col("label").alias("class"), F.col("n").alias("n_predicted"), "share"))
    return out, reduce(DataFrame.unionByName, summaries)


def _summary(spark: SparkSession, model: TextModel, error: str) -> DataFrame:
    return spark.createDataFrame(
        [(model.name, model.task, error, None, 0, 0.0)],
        "model string, task string, error string, class string, n_predicted bigint, share double",
    )


def training_job(
    df: DataFrame,
    task: str,
    family: str = "tfidf",
    key: str = "survey_id",
    stored: dict[str, str] | None = None,
    balancing: str = "class_weight",
    base: TextModel | None = None,
    seed: int = 42,
    **options,
) -> dict[str, object]:
    """Train on a user's table: find columns, clean texts and labels, split, balance, fit or warm-start, evaluate, profile."""
    roles = resolve_roles(df, stored)
    if roles.text is None or task not in roles.labels:
        raise ValueError(f"no text column or no label column for {task}")
    label = roles.labels[task]
    frame = df.select(key, F.col(roles.text).alias("text_feedback"), F.col(label).alias("_task_label"))
    clean = trainable_rows(preprocess(frame, "text_feedback"), "_task_label", strict=True)
    parts = settle(stratified_split(clean, "_task_label", key, seed=seed), "split")
    train, val, test = (parts.where(F.col("split") == s) for s in ("train", "val", "test"))
    fit_rows, fit_key = train, key
    if balancing == "oversample":
        # Repeated rows need their own id, or their terms would be merged.
        fit_rows = settle(oversample(train, "_task_label", key, seed).withColumn("_copy", F.concat_ws("#", key, "draw")), "balanced")
        fit_key = "_copy"
    elif balancing not in ("none", "class_weight"):
        raise ValueError(f"unknown balancing {balancing!r}")
    balanced = balancing == "class_weight"
    model = None
    if base is not None:
        model = warm_start(base, fit_rows, "_task_label", fit_key, balanced=balanced)
    if model is None:
        model = train_classifier(fit_rows, task, "_task_label", family, fit_key, balanced=balanced, **options)
    report = {s: model_metrics(model, rows, "_task_label", key) for s, rows in (("train", train), ("val", val), ("test", test))}
    out = {
        "model": model,
        "metrics": report,
        "profile": training_profile(train, "text_processed", "_task_label", model.weights),
    }
    if base is not None and base.classes == model.classes:
        out["comparison"] = compare_models(base, model, test, "_task_label", key)
    return out


def language_profiles(df: DataFrame, label: str, key: str, text: str, max_features: int | None = None) -> DataFrame:
    """(term, scores): log-probability of each character trigram in every language, add-one smoothed.

    The classes are the labels of the rows, in order. Every trigram counts unless ``max_features`` keeps the most frequent ones.
    """
    languages = [r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]
    terms = term_bags(df.where(F.col(key).isNotNull()), key, text, "char_ngram", 3, 3, keep=(label,)).select(label, F.inline("terms"))
    per = [F.sum(F.when(F.col(label) == l, F.col("tf")).otherwise(0)).alias(f"_c{i}") for i, l in enumerate(languages)]
    counts = terms.groupBy("term").agg(F.sum("tf").alias("total"), *per)
    kept = settle(counts, "trigrams") if max_features is None else most_frequent(counts, max_features)
    totals = kept.agg(F.count(F.lit(1)).alias("_v"), *[F.sum(f"_c{i}").alias(f"_t{i}") for i in range(len(languages))])
    from surveyloom.operators.common import with_scalars

    scores = [F.log((F.col(f"_c{i}") + 1.0) / (F.col(f"_t{i}") + F.col("_v"))) for i in range(len(languages))]
    return with_scalars(kept, totals).select("term", F.array(*scores).alias("scores")), languages


def detect_language(df: DataFrame, profiles: DataFrame, languages: list[str], key: str, text: str, default: str = "mixed") -> DataFrame:
    """(key, pred): the language whose profile gives the text the highest log-probability; blank texts get the default."""
    terms = TERM_FAMILIES["char_ngram"](df, key, text, 3, 3)
    sums = join_terms(terms, profiles).groupBy(key).agg(
        *[F.sum(F.col("tf") * F.col("scores")[i]).alias(f"_s{i}") for i in range(len(languages))]
    )
    totals = F.array(*[rounded(F.col(f"_s{i}"), 6) for i in range(len(languages))])
    names = F.array(*[F.lit(l) for l in languages])
    best = F.element_at(names, F.array_position(totals, F.array_max(totals)).cast("int"))
    return df.select(key).join(sums, key, "left").select(key, F.coalesce(best, F.lit(default)).alias("pred"))


def external_scores(
    df: DataFrame,
    key: str,
    text: str,
    loader: Callable[[], Callable[[list[str]], np.ndarray]],
    classes: list[str] | None = None,
    batch_size: int = 32,
) -> DataFrame:
    """Run any batch encoder over a text column: one load per worker, batches of texts in, logits or vectors out.

    With ``classes`` the output is (key, pred, conf, probabilities), otherwise (key, vector).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = loader()
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            chunks = [np.asarray(encoder(texts[i : i + batch_size]), dtype=float) for i in range(0, len(texts), batch_size)]
            rows = np.concatenate(chunks) if chunks else np.zeros((0, 1))
            yield pd.DataFrame({key: pdf[key], "vector": list(rows)})

    kind = dict(df.dtypes)[key]
    encoded = df.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<double>")
    if classes is None:
        return encoded
    scored = encoded.select(key, softmax(F.col("vector")).alias("probabilities"))
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_max("probabilities")
    return scored.select(
        key, F.element_at(names, F.array_position("probabilities", best).cast("int")).alias("pred"), best.alias("conf"), "probabilities"
    )


def pooled_vectors(tokens: DataFrame, key: str, vector: str, mask: str | None = None, first: str | None = None) -> DataFrame:
    """Mean of a document's unmasked token vectors, or its first token's vector when ``first`` names the order.

    Rows are (key, token vector). Components are summed as grouped rows, so a long document is never held whole.
    """
    if first is not None:
        return tokens.groupBy(key).agg(F.min_by(vector, first).alias("vector"))
    rows = tokens.where(F.col(mask)) if mask else tokens
    parts = rows.select(key, F.posexplode(vector).alias("dim", "v")).groupBy(key, "dim").agg(F.avg("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "v")))
    return parts.groupBy(key).agg(F.transform(ordered, lambda e: e["v"]).alias("vector"))
