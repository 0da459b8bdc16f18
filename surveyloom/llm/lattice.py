"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to two times eight dimensions, once per table, and each eight are decoded to the nearest point of the E8 lattice; the two points
together are a cell. A vector enters its own cell and probes the neighbouring cells it lies nearest to; two vectors meet where one's own cell is the other's own or probed one, and the
cosine of those that meet is computed in double precision. Equal vectors are merged before and counted as copies. Cells are found from keys alone;
vectors travel only to cells that hold two. A crowded cell is cut into blocks by a hash of the id, and pairs of blocks are compared
apart, so no cell is one task. A pair that meets in several cells counts in the first only, so links are sums, and each comparison returns
at most one row per vector, not pairs.

Two vectors of 64 dimensions at a cosine of 0.951 meet somewhere with a probability of 0.999, closer ones nearly always; two unrelated ones meet
anywhere once in 24,000 (both measured in ``tests/llm``). Pairs below the threshold are never reported. Candidates still grow with the rows, at that rate;
for far more of them ``points=3, tables=40, scale=0.6`` has the same recall, once in 660,000 and 200 entries a vector instead of 90.

Defined results: a vector that is null, zero, or holds a null, NaN or infinite component links with nothing; so do rows without an id; vectors of
different length never meet; repeated rows are copies and link with each other (ids are keys: of different vectors under one id one is compared); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import components, labels_of_graph
from surveyloom.session import settle

#: Lattice points of a cell, tables, probed cells per table, and length that unit vectors get before they are projected.
POINTS = 2
TABLES = 18
PROBES = 4
SCALE = 0.7
#: Rows of a cell that are compared in one go; rows and pairs that link, from which their cells are computed together.
BLOCK = 512
HELD_ROWS, HELD_PAIRS = 4096, 1 << 18


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for a, b in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[a], v[b] = s, t
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def nearest_point(y: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row: the nearer of the best points of D8 and of D8 shifted by a half."""

    def even(z: np.ndarray) -> np.ndarray:
        p = np.rint(z)
        odd = np.flatnonzero(p.sum(axis=1) % 2)
        rest = z[odd] - p[odd]
        worst = np.abs(rest).argmax(axis=1)
        p[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1, -1)
        return p

    whole, half = even(y), even(y - 0.5) + 0.5
    nearer = ((y - half) ** 2).sum(axis=1) < ((y - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


@lru_cache(maxsize=8)
def projections(dimensions: int, tables: int, points: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).standard_normal((tables, points, 8, dimensions))


def _key(points: np.ndarray, table: int, dimensions: int) -> np.ndarray:
    """64 bits of lattice points (last axis), table and vector length."""
    whole = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    h = np.full(whole.shape[:-1], (table + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64) ^ np.uint64(dimensions)
    for k in range(whole.shape[-1]):
        h = (h ^ whole[..., k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(
    x: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, points: int = POINTS, seed: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (n x tables) and probed cells (n x tables x probes) of unit vectors.

    A step to a neighbouring point costs the square distance that it adds; the probed cells are those with the cheapest steps of one or more points.
    """
    n, dimensions = x.shape
    own, near = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    for t, blocks in enumerate(projections(dimensions, tables, points, seed)):
        cost, place = np.zeros((n, 1)), np.empty((n, 1, 0))
        for r in blocks:
            y = (x @ r.T) * scale
            p = nearest_point(y)
            steps = 2.0 - 2.0 * ((y - p) @ roots().T)
            best = np.argpartition(steps, probes, axis=1)[:, :probes] if probes else np.empty((n, 0), int)
            reached = np.concatenate([p[:, None, :], p[:, None, :] + roots()[best]], axis=1)
            added = np.concatenate([np.zeros((n, 1)), np.take_along_axis(steps, best, axis=1)], axis=1)
            total = (cost[:, :, None] + added[:, None, :]).reshape(n, -1)
            kept = np.argsort(total[:, 1:], axis=1)[:, :probes] + 1  # place 0 is the cell without a step
            kept = np.concatenate([np.zeros((n, 1), int), kept], axis=1)
            before, after = np.divmod(kept, probes + 1)
            place = np.concatenate([np.take_along_axis(place, before[..., None], 1), np.take_along_axis(reached, after[..., None], 1)], axis=2)
            cost = np.take_along_axis(total, kept, axis=1)
        keys = _key(place, t, dimensions)
        own[:, t], near[:, t] = keys[:, 0], keys[:, 1:]
    return own, near


def units(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(v: Column) -> Column:
    """Vectors that can link: not null or empty, all components finite, one not zero."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda c: c != 0), F.lit(False))


def _by_length(vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, units([vectors[i] for i in at])


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, points: int = POINTS, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("x"))
    rows = rows.withColumn("usable", usable(F.col("x")) & F.col("vec_id").isNotNull())
    x = F.transform("x", lambda c: F.when(c == 0, 0.0).otherwise(c))  # -0.0 equals 0.0
    rows = rows.select("vec_id", "usable", F.when(F.col("usable"), x).alias("x"))
    digest = F.when(F.col("usable"), F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit("other"), "x").alias("b")))
    rows = rows.select("vec_id", "usable", "x", digest.alias("digest"))
    classes = rows.where("usable").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = settle(classes, "vector-classes")
    reps = rows.where("usable").join(classes, "digest").where("vec_id = rep").select(F.col("rep").alias("id"), "copies", "x").dropDuplicates(["id"])
    reps = settle(reps, "vectors")

    def enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column("id").to_numpy(zero_copy_only=False), batch.column("x").to_pylist()
            for at, unit in _by_length(held):
                for part in range(0, len(at), 4096):
                    own, near = cells(unit[part : part + 4096], tables, probes, scale, points)
                    key = np.concatenate([own[:, :, None], near], axis=2)
                    n = len(key)
                    place = np.broadcast_to(np.arange(probes + 1) == 0, key.shape)
                    t = np.broadcast_to(np.arange(tables, dtype=np.int32)[None, :, None], key.shape)
                    yield pa.RecordBatch.from_pydict(
                        {"cell": key.ravel(), "t": t.ravel(), "own": place.ravel(), "id": np.repeat(ids[at[part : part + n]], tables * (probes + 1))}
                    )

    entries = settle(reps.select("id", "x").mapInArrow(enter, "cell long, t int, own boolean, id long"), "cells")
    crowd = entries.groupBy("cell", "t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("int")).alias("owners"))
    crowd = crowd.where("n >= 2 and owners >= 1").select("cell", "t", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    live = entries.join(crowd, ["cell", "t"])
    live = live.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    live = live.select("cell", "t", "own", "id", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    met = live.join(reps, "id")
    met = met.repartition("cell", "t", "i", "j").sortWithinPartitions("t", "cell", "i", "j", "id")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Hits] = []
        rows = pairs = 0
        for group in _groups(batches, ["cell", "t", "i", "j"]):
            hits = _hits(group, threshold)
            if hits is None:
                continue
            held.append(hits)
            rows, pairs = rows + len(hits.ids), pairs + len(hits.a)
            if rows >= HELD_ROWS or pairs >= HELD_PAIRS:
                yield from _links(held, tables, probes, scale, points)
                held, rows, pairs = [], 0, 0
        yield from _links(held, tables, probes, scale, points)

    linked = settle(met.mapInArrow(compare, "id long, links long, root long"), "links")
    n_links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    component = components(linked.where("id <> root"), "id", "root")
    of_class = classes.join(n_links, classes.rep == n_links.id, "left").drop("id").join(component, F.col("rep") == component.id, "left").drop("id")
    of_class = of_class.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "digest").join(of_class, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a sorted stream; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(k[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Hits(NamedTuple):
    """The rows of a group that link, the pairs of them, and the smallest id each reaches inside the group."""

    x: np.ndarray
    ids: np.ndarray
    copies: np.ndarray
    root: np.ndarray
    a: np.ndarray
    b: np.ndarray
    t: int
    cell: int


def _hits(group: pa.Table, threshold: float) -> Hits | None:
    if group.num_rows < 2:
        return None
    own = group["own"].to_numpy(zero_copy_only=False).astype(bool)
    ids, copies, part = (group[c].to_numpy() for c in ("id", "copies", "part"))
    cell, t, i, j = (group[c][0].as_py() for c in ("cell", "t", "i", "j"))
    x = group["x"].combine_chunks()
    x = units(x.flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1))
    hit = np.triu(x @ x.T >= threshold, 1)
    hit &= own[:, None] | own[None, :]
    if i != j:
        hit &= part[:, None] != part[None, :]
    a, b = np.nonzero(hit)
    if not len(a):
        return None
    linked, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = places.reshape(2, -1)
    root = labels_of_graph(len(linked), a, b)
    return Hits(x[linked], ids[linked], copies[linked], ids[linked][root], a, b, t, cell)


def _links(held: list[Hits], tables: int, probes: int, scale: float, points: int) -> Iterator[pa.RecordBatch]:
    """id, links and root of the rows of many groups. Their cells are computed together; a pair counts where it meets first."""
    for width in sorted({h.x.shape[1] for h in held}):
        some = [h for h in held if h.x.shape[1] == width]
        offset = np.cumsum([0, *[len(h.ids) for h in some]])
        a, b = (np.concatenate([pair + o for pair, o in zip(side, offset, strict=False)]) for side in ([h.a for h in some], [h.b for h in some]))
        sizes = [len(h.a) for h in some]
        t, cell = np.repeat([h.t for h in some], sizes), np.repeat(np.array([h.cell for h in some], np.int64), sizes)
        home, near = cells(np.concatenate([h.x for h in some]), min(tables, int(t.max()) + 1), probes, scale, points)
        counted = np.ones(len(a), bool)
        for table in range(home.shape[1]):
            ha, hb = home[a, table], home[b, table]
            b_probed = (near[a, table] == hb[:, None]).any(axis=1)
            a_probed = (near[b, table] == ha[:, None]).any(axis=1)
            counted &= ~((table < t) & ((ha == hb) | b_probed | a_probed))
            # ids are in order: the first of the meeting places in this table
            counted &= (table != t) | (np.where((ha == hb) | ~b_probed, ha, hb) == cell)
        ids, copies, root = (np.concatenate([getattr(h, name) for h in some]) for name in ("ids", "copies", "root"))
        links = np.bincount(a[counted], copies[b[counted]], len(ids)) + np.bincount(b[counted], copies[a[counted]], len(ids))
        show = (links > 0) | (root != ids)
        yield pa.RecordBatch.from_pydict({"id": ids[show], "links": np.rint(links[show]).astype(np.int64), "root": root[show]})
