"""Hard-negative mining by vertical scans (branch and bound on decomposed vectors).

Components become the integers ``floor(256 * x)``; a row's score is its integer inner product with the anchor. Rows are dealt by a hash to segments of
bounded size. A task holds one segment at a time as columns, one array per dimension, with the smallest and largest value of each column. The anchors
then stream past it. For an anchor, columns are read in the order of its descending magnitudes; what the columns not read yet can still add lies
between sums of their minima and maxima, and a bitmap of candidates shrinks to those that these bounds leave possible, until the scores are exact.

Two scans are made. The first finds each anchor's positives: its nearest rows of the same label. Their scores fix one window of scores per positive;
the second scan finds the first rows of other labels inside each window. Every segment gives at most as many rows per anchor and window as are wanted;
they are merged in steps of a bounded number of segments. Rows are moved once per scan, anchors once per segment; nothing passes through the driver but the row count.

Defined results: rows with a null label or vector, an empty vector, a null, NaN or infinite component, or no id take no part. Vectors of
different lengths never meet. Equal rows under one id count once; different rows under one id are rows of their own, each an anchor if the id is one,
told apart by a hash of their content (ties go by id, then by it). Components beyond ``limit(length)`` after scaling, some 2**27, are cut to it, so that
scores fit 64 bits. A positive with a negative score has an empty window. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.session import settle

#: Rows of a segment at most, on average: as columns of 64 small integers it takes 16 MB. The larger, the fewer copies of the anchors are moved.
SEGMENT = 131_072
#: Smaller inputs make more segments, one per shuffle partition, of so many rows at least.
LEAST_SEGMENT = 4096
#: Segments whose finds are merged in one step.
MERGED = 64
#: Columns read between two looks at the bounds.
STRIDE = 8

FOUND = "segment int, vec_id long, row long, window int, score long, other_id long, other_row long"


def limit(length: int) -> int:
    """Largest magnitude of a scaled component, so that a sum of ``length`` products fits 62 bits."""
    return math.isqrt((1 << 62) // max(length, 1))


def quantised(vectors: DataFrame, label: Column, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, row, label, q) of the rows that take part; ``q`` holds ``floor(256 * x)``, ``row`` is a hash of the content."""
    x = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where("vec_id is not null and label is not null and x is not null").where((F.size("x") > 0) & ~F.coalesce(bad, F.lit(True)))
    top = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.size("x")))
    scaled = F.transform("x", lambda c: F.greatest(F.least(F.floor(F.least(F.greatest(c * 256, F.lit(-1e15)), F.lit(1e15))), top), -top).cast("long"))
    rows = rows.select("vec_id", "label", scaled.alias("q"))
    rows = rows.withColumn("row", F.xxhash64("label", "q"))
    return rows.dropDuplicates(["vec_id", "row"]).select("vec_id", "row", "label", "q")


def scan(columns: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, alive: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the rows that may be among the first ``k`` of any window, by reading columns until the bounds decide.

    ``low`` and ``high`` are the extremes of each column; ``alive`` is the bitmap of candidates. A row is out of a window where its best
    possible score lies below the window or below ``k`` rows that are sure to be inside, or its worst possible score lies above the window.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    a = anchor[order]
    ends = np.stack([low[order] * a, high[order] * a])
    left = np.concatenate([ends.min(axis=0)[::-1].cumsum()[::-1], [0]])
    right = np.concatenate([ends.max(axis=0)[::-1].cumsum()[::-1], [0]])
    at = np.flatnonzero(alive)
    score = np.zeros(len(at), anchor.dtype)
    whole = len(at) == columns.shape[1]
    for begin in range(0, len(a), STRIDE):
        if not len(at):
            break
        dims = order[begin : begin + STRIDE]
        for d in dims:
            score += columns[d] * anchor[d] if whole else columns[d][at] * anchor[d]
        done = min(begin + STRIDE, len(a))
        worst, best = score + left[done], score + right[done]
        keep = np.zeros(len(at), bool)
        for bottom, top in windows:
            sure = worst[(worst >= bottom) & (best <= top)]
            if len(sure) >= k:
                bottom = max(bottom, np.partition(sure, len(sure) - k)[len(sure) - k])
            keep |= (best >= bottom) & (worst <= top)
        if not keep.all():
            at, score, whole = at[keep], score[keep], False
    return at, score


def _first(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((rows[some], ids[some], -score[some]))[:k]]


def _segment(batches: list[pa.RecordBatch]) -> dict[int, dict]:
    """Columns by vector length."""
    held = pa.Table.from_batches(batches)
    q = held["q"].combine_chunks()
    length = np.diff(q.offsets.to_numpy())
    values = q.values.to_numpy()[q.offsets[0].as_py() :]
    begin = q.offsets.to_numpy()[:-1] - q.offsets[0].as_py()
    ids, rows, labels = (held[c].to_numpy() for c in ("vec_id", "row", "label"))
    out = {}
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        columns = np.empty((n, len(at)), np.int64)
        for d in range(n):
            columns[d] = values[begin[at] + d]
        low, high = columns.min(axis=1), columns.max(axis=1)
        peak = int(max(-low.min(), high.max(), 1))
        columns = columns.astype(np.int16) if peak < 1 << 15 else columns
        out[int(n)] = {"q": columns, "low": low, "high": high, "ids": ids[at], "rows": rows[at], "labels": labels[at], "peak": peak}
    return out


def _exact(part: dict, anchor: np.ndarray) -> np.ndarray:
    """The anchor in doubles where every partial sum and bound is an integer below 2**52, else in 64-bit integers; products take its type."""
    return anchor.astype(np.float64) if len(anchor) * part["peak"] * int(np.abs(anchor).max()) < 1 << 51 else anchor


def _look(rows: DataFrame, anchors: DataFrame, k: int, same_label: bool, segments: int) -> DataFrame:
    """At most ``k`` rows per segment, anchor and window. ``anchors`` has vec_id, row, label, q and the windows ``bottom`` and ``top`` (arrays)."""
    dealt = F.pmod(F.xxhash64("vec_id", "row"), F.lit(segments)).cast("int")
    none = F.lit(None).cast("array<long>")
    held = rows.select(dealt.alias("segment"), F.lit(0).alias("kind"), "vec_id", "row", "label", "q", none.alias("bottom"), none.alias("top"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"), F.lit(1).alias("kind"), "vec_id", "row", "label", "q", "bottom", "top")
    both = held.unionByName(asked).repartition(segments, "segment").sortWithinPartitions("segment", "kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        parts: dict[int, dict] = {}
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            segment, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("segment", "kind"))
            cuts = [0, *(np.flatnonzero((np.diff(segment) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if segment[a] != current:
                    waiting, parts, current = [], {}, segment[a]
                if kind[a] == 0:
                    waiting.append(batch.select(["vec_id", "row", "label", "q"]).slice(a, b - a))
                    continue
                if waiting:
                    parts, waiting = _segment(waiting), []
                out = [x for x in (_ask(parts, *row, k, same_label) for row in _unpacked(batch.slice(a, b - a))) if x is not None]
                if out:
                    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), current, np.int32)), *map(pa.array, columns)], names=[f.split()[0] for f in FOUND.split(", ")])

    return both.mapInArrow(run, FOUND)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    q = batch.column("q")
    offsets, values = q.offsets.to_numpy(), q.values.to_numpy()
    rest = [batch.column(c).to_pylist() for c in ("vec_id", "row", "label", "bottom", "top")]
    for i, (vec_id, row, label, bottom, top) in enumerate(zip(*rest, strict=True)):
        yield vec_id, row, label, values[offsets[i] : offsets[i + 1]], list(zip(bottom, top, strict=True))


def _ask(parts: dict[int, dict], vec_id: int, row: int, label: int, anchor: np.ndarray, windows: list[tuple], k: int, same_label: bool) -> tuple | None:
    part = parts.get(len(anchor))
    if part is None or not windows:
        return None
    if same_label:
        alive = (part["labels"] == label) & ~((part["ids"] == vec_id) & (part["rows"] == row))
    else:
        alive = part["labels"] != label
    spans = [(-math.inf if b is None else b, math.inf if t is None else t) for b, t in windows]
    at, score = scan(part["q"], part["low"], part["high"], _exact(part, anchor), alive, spans, k)
    score = score.astype(np.int64)
    found = []
    for w, (bottom, top) in enumerate(spans):
        inside = np.flatnonzero((score >= bottom) & (score <= top))
        best = inside[_first(score[inside], part["ids"][at[inside]], part["rows"][at[inside]], k)]
        if len(best):
            n = len(best)
            found.append((np.full(n, vec_id), np.full(n, row), np.full(n, w, np.int32), score[best], part["ids"][at[best]], part["rows"][at[best]]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else None


def _merged(found: DataFrame, k: int, segments: int) -> DataFrame:
    """The first ``k`` of each anchor and window over all segments, with their ``rank``."""
    order = [F.desc("score"), F.asc("other_id"), F.asc("other_row")]
    while True:
        groups = Window.partitionBy("vec_id", "row", "window", "segment")
        last = segments <= MERGED
        found = found.withColumn("segment", F.lit(0) if last else F.floor(F.col("segment") / MERGED).cast("int"))
        found = found.withColumn("rank", F.row_number().over(groups.orderBy(*order))).where(F.col("rank") <= k)
        if last:
            return found.drop("segment")
        segments = -(-segments // MERGED)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    low: tuple[int, int] = (30, 100),
    high: tuple[int, int] = (90, 100),
    segment: int = SEGMENT,
    least: int = LEAST_SEGMENT,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, embedding and label; ``is_anchor`` is a condition on ``vec_id``, ``label`` what stands for the label. A negative's score lies
    between ``low`` and ``high`` (fractions, ends included) of the positive's.
    """
    rows = settle(quantised(vectors, F.col("label") if label is None else label), "quantised")
    n = rows.count()
    segments = max(1, -(-n // segment), min(-(-n // least), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    anchors = rows.where(is_anchor)
    free = F.array(F.lit(None).cast("long"))
    found = _look(rows, anchors.withColumns({"bottom": free, "top": free}), positives, True, segments)
    chosen = _merged(found, positives, segments).select("vec_id", "row", "rank", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    chosen = settle(chosen, "positives")
    # ceil(low * p) and floor(high * p) in integers: the bounds of a window of scores
    bottom = F.expr(f"(cast({low[0]} as decimal(10,0)) * positive_score + {low[1] - 1}) div {low[1]}").cast("long")
    top = F.expr(f"(cast({high[0]} as decimal(10,0)) * positive_score) div {high[1]}").cast("long")
    wanted = chosen.where("positive_score >= 0").groupBy("vec_id", "row")
    wanted = wanted.agg(F.sort_array(F.collect_list(F.struct("rank", bottom.alias("b"), top.alias("t")))).alias("w"))  # ``positives`` at most
    asked = anchors.join(wanted, ["vec_id", "row"]).withColumns({"bottom": F.col("w.b"), "top": F.col("w.t")})
    found = _look(rows, asked, negatives, False, segments)
    # windows are numbered in the order of the positives' ranks, which start at 1; negative scores come last
    hard = _merged(found, negatives, segments).withColumn("window", F.col("window") + 1)
    hard = hard.select("vec_id", "row", F.col("window").alias("place"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = hard.join(chosen.withColumnRenamed("rank", "place"), ["vec_id", "row", "place"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
