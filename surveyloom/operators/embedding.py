"""Two-dimensional projection and k-means clustering of documents."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.numbers import rounded
from surveyloom.operators import density
from surveyloom.operators.classify import TextModel
from surveyloom.operators.features import MAX_BROADCAST_TERMS, sparse_rows, sparse_texts, tfidf, vocabulary, with_idf, word_terms
from surveyloom.operators.schema import label_columns
from surveyloom.operators.scoring import local_rows
from surveyloom.operators.versions import fingerprint
from surveyloom.session import packed, settle, side_by_side
from surveyloom.sources import markers

#: Extra directions of the subspace iteration, its largest number of passes, and the residual at which it has converged.
EXTRA, PASSES, TOLERANCE = 8, 60, 1e-4

#: Up to so many dimensions the covariance itself is summed in one pass (half a megabyte per task), and rows it is made of at a time.
EXACT_SIZE, CHUNK = 256, 4096


class Projection(NamedTuple):
    """Points (key, x, y), the components' shares of variance, and how far the iteration got."""

    points: DataFrame
    shares: list[float]
    converged: bool
    passes: int
    residual: float


def project(rows: DataFrame, key: str, size: int, passes: int = PASSES, tolerance: float = TOLERANCE) -> Projection:
    """(key, x, y): centred coordinates on the first two principal components, their shares of variance, and whether they converged.

    ``rows`` holds sparse vectors of ``size`` numbers as ``indices`` and ``values``. Up to ``EXACT_SIZE`` dimensions the covariance is summed in one pass
    and its components are exact. Beyond that, subspace iteration: a few random directions are multiplied by
    the covariance again and again, each time as a sum over rows, so no matrix is wider than those directions, whatever the size. It ends when the
    covariance turns neither component out of itself by more than ``tolerance`` of its variance, or after ``passes`` passes, which the result tells.
    Each component is turned so that its largest weight is positive.
    """
    k = min(2, size)
    width = min(size, k + EXTRA)
    data = settle(rows.select(key, "indices", "values"), "sparse")
    cells = data.select(F.inline(F.arrays_zip("indices", "values")))
    sums = cells.groupBy("indices").agg(F.sum("values").alias("s"), F.sum(F.col("values") * F.col("values")).alias("q")).toPandas()
    n = max(1, data.count())
    mean, square = np.zeros(size), np.zeros(size)
    mean[sums["indices"].to_numpy(int)], square[sums["indices"].to_numpy(int)] = sums["s"] / n, sums["q"]
    total = float(square.sum() - n * (mean * mean).sum())
    spark = rows.sparkSession

    def summed(shape: tuple[int, int], add: Callable[[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray], None]) -> np.ndarray:
        """Sum over all rows of what ``add`` puts into a matrix of that shape, given (row, indices, values, rows) of a batch."""

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(shape)
            for pdf in batches:
                if len(pdf):
                    row = np.repeat(np.arange(len(pdf)), pdf["indices"].map(len).to_numpy())
                    add(row, np.concatenate(pdf["indices"].to_list()).astype(np.int64), np.concatenate(pdf["values"].to_list()), len(pdf), out)
            yield pd.DataFrame({"g": [out.ravel()]})

        parts = data.mapInPandas(part, "g array<double>").select(array_to_vector("g").alias("g"), F.pmod(F.spark_partition_id(), F.lit(32)).alias("stage"))
        staged = parts.groupBy("stage").agg(Summarizer.sum(F.col("g")).alias("g"))
        found = staged.agg(Summarizer.sum(F.col("g")).alias("g")).first()
        return found["g"].toArray().reshape(shape)

    def covariance() -> np.ndarray:
        def add(row, indices, values, count, out):
            for low in range(0, count, CHUNK):
                chosen = slice(*np.searchsorted(row, [low, low + CHUNK]))
                block = np.zeros((min(CHUNK, count - low), size))
                block[row[chosen] - low, indices[chosen]] = values[chosen]
                block -= mean
                out += block.T @ block

        return summed((size, size), add)

    def passed(q: np.ndarray) -> np.ndarray:
        """Covariance times ``q`` (size x width), not divided by n."""
        shipped = spark.sparkContext.broadcast((q, mean @ q))

        def add(row, indices, values, count, out):
            q, shift = shipped.value
            seen = np.stack([np.bincount(row, q[indices, c] * values, count) for c in range(q.shape[1])], axis=1) - shift
            # the mean's own part falls away, since centred coordinates add up to nothing
            for c in range(q.shape[1]):
                out[:, c] += np.bincount(indices, seen[row, c] * values, len(q))

        found = summed(q.shape, add)
        shipped.destroy()
        return found

    done, residual = 1, 0.0
    if size <= EXACT_SIZE:
        shares, turns = np.linalg.eigh(covariance())
        shares, loadings = shares[::-1][:k], turns[:, ::-1][:, :k]
    else:
        q, done = np.linalg.qr(np.random.default_rng(0).standard_normal((size, width)))[0], 0
        while True:
            image, done = passed(q), done + 1
            inner = q.T @ image
            shares, turns = np.linalg.eigh((inner + inner.T) / 2.0)
            shares, turns = shares[::-1][:k], turns[:, ::-1][:, :k]
            loadings = q @ turns
            left = np.linalg.norm(image @ turns - loadings * shares, axis=0)
            # a component without variance is held against the whole
            residual = float(np.max(left / np.where(shares > 1e-12 * total, shares, max(total, 1e-300))))
            if residual <= tolerance or done >= passes:
                break
            q = np.linalg.qr(image)[0]
    loadings *= np.where(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)] >= 0, 1.0, -1.0)
    shift = mean @ loadings
    table = settle(spark.createDataFrame(pd.DataFrame({"idx": np.arange(size), "w": list(loadings.tolist())}), "idx int, w array<double>"), "loadings")
    flat = data.select(key, F.inline(F.arrays_zip("indices", "values"))).withColumnsRenamed({"indices": "idx"})
    table = F.broadcast(table) if size <= MAX_BROADCAST_TERMS else table
    placed = flat.join(table, "idx").groupBy(key).agg(*[F.sum(F.col("values") * F.col("w")[i]).alias(f"_p{i}") for i in range(k)])
    axes = [(F.coalesce(f"_p{i}", F.lit(0.0)) - float(shift[i])).alias(c) for i, c in enumerate(["x", "y"][:k])]
    axes += [F.lit(0.0).alias("y")] * (2 - k)
    points = data.select(key).join(placed, key, "left").select(key, *axes)
    return Projection(points, [float(v) / total if total > 0 else 0.0 for v in shares], residual <= tolerance, done, residual)


def project_texts(df: DataFrame, key: str, text: str, max_features: int = 512) -> Projection:
    """Project documents by the TF-IDF (plain term counts) of the most frequent 1- and 2-grams."""
    vocab = settle(with_idf(vocabulary(word_terms(df, key, text), key, max_features), df), "vocabulary")
    rows = sparse_texts(df, key, text, "tfidf", vocab, max_features, sublinear=False)
    return _labelled(project(rows, key, max(1, vocab.count())), df, key)


def _labelled(found: Projection, df: DataFrame, key: str) -> Projection:
    """Points with the known labels of their rows, missing ones as empty text."""
    kept = label_columns(df)
    return found._replace(points=found.points.join(df.select(key, *kept).fillna("", subset=kept), key))


def project_by_model(model: TextModel, df: DataFrame, key: str) -> Projection:
    """Project documents by the vectors a trained model sees: its own vocabulary and inverse document frequencies, all its terms.

    A text without a known term is the zero vector. Where the model's table is small enough to broadcast the vectors are made inside their rows, else by joins.
    """
    table = model.table()
    if table is not None:
        rows = local_rows(df.select(key, model.text_column), model.text_column, model.family, table).select(key, "indices", "values")
    else:
        weights = tfidf(model.terms(df, key), model.weights.select("term", "idx", "idf"), key, model.max_features)
        rows = sparse_rows(weights, df, key)
    size = model.weights.agg(F.max("idx")).first()[0]
    return _labelled(project(rows, key, 1 if size is None else size + 1), df, key)


def model_id(model: TextModel) -> str:
    """Identity of what a model does to a text: its terms, their numbers and inverse document frequencies, and the kind of its features."""
    made = fingerprint(model.weights.select("term", "idx", "idf")).first()["snapshot_id"]
    return f"{model.family}-{model.text_column}-{made}"


def cached_points(spark: SparkSession, root: str, snapshot: str, model: str, parameters: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """Points of a snapshot under a model and parameters: read where they were written before, else built and written.

    Points are written to a folder of their own and exist from the moment a marker names it, so a build that broke off is never read, and of two builds at
    once the first to end counts for both.
    """
    marker = _points_of(root, snapshot) + "/" + hashlib.sha256(json.dumps([model, parameters], sort_keys=True).encode()).hexdigest() + ".json"
    if not markers.exists(spark, marker):
        path = f"{_points_of(root, snapshot)}/{uuid.uuid4().hex}"
        build().write.parquet(path)
        if not markers.create_once(spark, marker, json.dumps({"path": path})):
            markers.drop(spark, path)
    return spark.read.parquet(spark.read.schema("path string").json(marker).first()["path"])


def forget_points(spark: SparkSession, root: str, snapshot: str) -> None:
    """Drop all points of a snapshot, whatever the model."""
    markers.drop(spark, _points_of(root, snapshot))


def _points_of(root: str, snapshot: str) -> str:
    return f"{root.rstrip('/')}/points/n{quote(snapshot, safe='')}"


def kmeans(points: DataFrame, k: int = 3, starts: int = 10, seed: int = 42) -> tuple[DataFrame, float]:
    """Add ``cluster``: the best of several k-means starts by total squared distance."""
    n = points.limit(max(1, k)).count()
    data = VectorAssembler(inputCols=["x", "y"], outputCol="_point").transform(points)
    rows = packed(data, data.count())

    def start(i: int):
        model = KMeans(k=max(1, min(k, n)), seed=seed + i, featuresCol="_point", predictionCol="cluster").fit(rows)
        return model.summary.trainingCost, i, model

    cost, _, model = min(side_by_side([lambda i=i: start(i) for i in range(starts)]), key=lambda f: f[:2])
    return model.transform(data).drop("_point"), cost


def cluster_sizes(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    return assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def flag_top_share(scored: DataFrame, score: str = "outlier_score", contamination: float = 0.1) -> DataFrame:
    """Mark the rows whose score lies above the exact (1 - contamination) quantile; scores are shown with six decimals. No score is no outlier."""
    from surveyloom.operators.ranks import exact_quantiles

    rows = scored.select(F.lit("all").alias("_key"), score)
    limit = exact_quantiles(rows, ["_key"], F.col(score), [1.0 - contamination]).select("_key", F.col("q0").alias("_limit"))
    joined = scored.withColumn("_key", F.lit("all")).join(F.broadcast(limit), "_key", "left")
    return joined.withColumn("is_outlier", F.coalesce(F.col(score) > F.col("_limit"), F.lit(False))).withColumn(score, rounded(F.col(score), 6)).drop("_key", "_limit")


def outlier_table(points: DataFrame, key: str, method: str = "lof", contamination: float = 0.1, neighbours: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(key, x, y, outlier_score, is_outlier) of every row, and one row of method, n_neighbors, n_rows and n_outliers.

    Fewer than three points have no neighbourhoods to compare: the forest scores them. Neighbours are at least two and at most all the others.
    """
    if method not in ("lof", "isolation_forest"):
        raise ValueError(f"unknown method {method!r}")
    rows = density.placed_rows(points, key).where("x IS NOT NULL").limit(neighbours + 1).count()
    used = method if method == "isolation_forest" or rows >= 3 else "isolation_forest"
    k = max(2, min(neighbours, max(2, rows - 1)))
    scored = density.local_outlier_factor(points, key, k) if used == "lof" else density.isolation_scores(points, key, seed=seed)
    found = settle(flag_top_share(settle(scored, "scores"), contamination=contamination), "outliers")
    about = found.agg(
        F.lit(used).alias("method"),
        F.lit(k if used == "lof" else None).cast("int").alias("n_neighbors"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_outlier").alias("n_outliers"),
    )
    return found, about


def cluster_table(points: DataFrame, key: str, method: str = "kmeans", k: int = 3, eps: float = 0.5, min_samples: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(key, x, y, cluster) of every row, and the number of rows of each cluster. Noise, and rows without a place, are in cluster -1."""
    if method == "dbscan":
        found = points.select(key, "x", "y").join(density.dbscan(points, key, eps, min_samples).select(key, "cluster"), key)
    elif method == "kmeans":
        placed = density.placed_rows(points, key).where("x IS NOT NULL")
        if placed.isEmpty():
            found = points.select(key, "x", "y", F.lit(-1).alias("cluster"))
        else:
            clusters = kmeans(settle(placed, "placed"), k, seed=seed)[0].select(key, "cluster")
            found = points.select(key, "x", "y").join(clusters, key, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    else:
        raise ValueError(f"unknown method {method!r}")
    found = settle(found.withColumn("cluster", F.col("cluster").cast("bigint")), "clusters")
    return found, cluster_sizes(found)
