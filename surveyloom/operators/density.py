"""Density clustering and outlier scores of points in the plane, without comparing every pair.

Equal points are merged first and carry a weight, so a place that holds a third of all rows is one location. What is
left is cut into cells whose work is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numbers import uniform_from_hash
from surveyloom.operators.ranks import dense_index, hash_rank, top_per_group
from surveyloom.session import settle

MAX_PAIRS = 4096
FANOUT = 64


def placed_rows(points: DataFrame, key: str) -> DataFrame:
    """(key, x, y) of every row; coordinates that are missing or not numbers are null, together."""
    x, y = (F.col(c).cast("double") for c in ("x", "y"))
    known = ~(F.coalesce(F.isnan(x) | F.isnan(y) | (F.abs(x) == float("inf")) | (F.abs(y) == float("inf")), F.lit(True)))
    return points.select(key, F.when(known, x).alias("x"), F.when(known, y).alias("y"))


def locations(points: DataFrame, key: str) -> DataFrame:
    """(x, y, w, first): distinct places with the number of rows and the smallest key at each; rows without a place are left out."""
    return (
        placed_rows(points, key)
        .where("x IS NOT NULL")
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("w"), F.min(key).alias("first"))
    )


def _squared(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


# Cells have diagonal eps: two points of one cell are always neighbours, and neighbours are at most two cells apart.
_REACH = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (abs(i), abs(j)) != (2, 2)]


def _around(cx: Column, cy: Column) -> Column:
    return F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i, j in _REACH])


def dbscan_cores(points: DataFrame, key: str, eps: float, min_samples: int, salts: int = 8) -> DataFrame:
    """(x, y, w, first, cx, cy, is_core) per distinct place.

    A cell with min_samples rows has only core points, with nothing to compare. The few rows of the other cells look
    for neighbours in the cells around; those rows are repeated per salt so that a crowded cell is shared by tasks.
    """
    side = eps / np.sqrt(2.0)
    placed = locations(points, key).withColumns(
        {"cx": F.floor(F.col("x") / side).cast("bigint"), "cy": F.floor(F.col("y") / side).cast("bigint")}
    )
    placed = settle(placed, "places")
    cells = placed.groupBy("cx", "cy").agg(F.sum("w").alias("n"))
    crowded = cells.where(F.col("n") >= min_samples).select("cx", "cy")
    dense = placed.join(crowded, ["cx", "cy"], "left_semi").withColumn("is_core", F.lit(True))
    sparse = placed.join(crowded, ["cx", "cy"], "left_anti")
    asking = sparse.select(
        F.col("x").alias("qx"), F.col("y").alias("qy"), F.inline(_around(F.col("cx"), F.col("cy")))
    ).withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(salts)])))
    offered = placed.select("x", "y", "w", "cx", "cy", F.pmod(F.hash("x", "y"), F.lit(salts)).alias("salt"))
    near = asking.join(offered, ["cx", "cy", "salt"]).where(
        _squared(F.col("qx"), F.col("qy"), F.col("x"), F.col("y")) <= eps * eps
    )
    found = near.groupBy("qx", "qy").agg(F.sum("w").alias("m"))
    decided = sparse.join(found.withColumnsRenamed({"qx": "x", "qy": "y"}), ["x", "y"], "left").withColumn(
        "is_core", F.coalesce(F.col("m") >= min_samples, F.lit(False))
    )
    return dense.unionByName(decided.drop("m")).select("x", "y", "w", "first", "cx", "cy", "is_core")


def dbscan_flags(points: DataFrame, key: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(key, is_core) of every row; one without a place is no core."""
    cores = dbscan_cores(points, key, eps, min_samples).select("x", "y", "is_core")
    return placed_rows(points, key).join(cores, ["x", "y"], "left").select(key, F.coalesce("is_core", F.lit(False)).alias("is_core"))


def _linked_cells(cores: DataFrame, eps: float, side: float) -> DataFrame:
    """(a, b) pairs of cells that hold core points within eps of each other.

    Pairs of neighbouring cells descend together: boxes that are surely within eps link their cells, boxes surely
    apart are dropped, and only boxes at the limit are split in four and tried again. Small boxes are compared point
    by point. A crowded pair of cells therefore costs its border, not its product.
    """
    limit = eps * eps
    rows = cores.select("x", "y", F.concat_ws(":", "cx", "cy").alias("cell"), "cx", "cy")
    linked, open_pairs = [], None
    level = 0
    while True:
        step = side / 2**level
        rows_l = rows.withColumns(
            {"bx": F.floor(F.col("x") / step).cast("bigint"), "by": F.floor(F.col("y") / step).cast("bigint")}
        )
        boxes = rows_l.groupBy("cell", "cx", "cy", "bx", "by").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("x").alias("x0"),
            F.max("x").alias("x1"),
            F.min("y").alias("y0"),
            F.max("y").alias("y1"),
        )
        a = boxes.select([F.col(c).alias(f"a_{c}") for c in boxes.columns])
        b = boxes.select([F.col(c).alias(f"b_{c}") for c in boxes.columns])
        if open_pairs is None:
            around = a.select("*", F.inline(_around(F.col("a_cx"), F.col("a_cy")))).withColumnsRenamed(
                {"cx": "b_cx", "cy": "b_cy"}
            )
            pairs = around.join(b, ["b_cx", "b_cy"]).where(F.col("a_cell") < F.col("b_cell"))
        else:
            up = lambda c: F.floor(F.col(c) / 2).cast("bigint")
            kids_a = a.withColumns({"a_px": up("a_bx"), "a_py": up("a_by")})
            kids_b = b.withColumns({"b_px": up("b_bx"), "b_py": up("b_by")})
            pairs = open_pairs.join(kids_a, ["a_cell", "a_px", "a_py"]).join(kids_b, ["b_cell", "b_px", "b_py"])
        gap_x = F.greatest(F.lit(0.0), F.col("a_x0") - F.col("b_x1"), F.col("b_x0") - F.col("a_x1"))
        gap_y = F.greatest(F.lit(0.0), F.col("a_y0") - F.col("b_y1"), F.col("b_y0") - F.col("a_y1"))
        far_x = F.greatest(F.col("a_x1") - F.col("b_x0"), F.col("b_x1") - F.col("a_x0"))
        far_y = F.greatest(F.col("a_y1") - F.col("b_y0"), F.col("b_y1") - F.col("a_y0"))
        judged = pairs.withColumn("sure", far_x * far_x + far_y * far_y <= limit).where(
            F.col("sure") | (gap_x * gap_x + gap_y * gap_y <= limit)
        )
        judged = settle(
            judged.select("a_cell", "b_cell", "a_bx", "a_by", "b_bx", "b_by", "sure", (F.col("a_n") * F.col("b_n")).alias("work")),
            "boxes",
        )
        sure = judged.where("sure").select("a_cell", "b_cell").distinct()
        undecided = judged.join(sure, ["a_cell", "b_cell"], "left_anti")
        linked.append(sure)
        small = undecided.where(F.col("work") <= MAX_PAIRS)
        members = rows_l.select("cell", "bx", "by", "x", "y")
        left = members.select([F.col(c).alias(f"a_{c}") for c in members.columns])
        right = members.select([F.col(c).alias(f"b_{c}") for c in members.columns])
        touching = (
            small.join(left, ["a_cell", "a_bx", "a_by"])
            .join(right, ["b_cell", "b_bx", "b_by"])
            .where(_squared(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")) <= limit)
            .select("a_cell", "b_cell")
            .distinct()
        )
        linked.append(settle(touching, "links"))
        rest = undecided.where(F.col("work") > MAX_PAIRS).join(linked[-1], ["a_cell", "b_cell"], "left_anti")
        open_pairs = settle(
            rest.select(
                "a_cell", "b_cell", F.col("a_bx").alias("a_px"), F.col("a_by").alias("a_py"),
                F.col("b_bx").alias("b_px"), F.col("b_by").alias("b_py"),
            ),
            "open",
        )
        if open_pairs.isEmpty():
            break
        level += 1
    out = linked[0]
    for more in linked[1:]:
        out = out.unionByName(more)
    return out.distinct()


def connected_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component.

    Every round joins each node to the smallest node its neighbours know and then jumps along the labels, so the
    number of rounds grows with the logarithm of the component's width. Grouped minima only; each round is written out.
    """
    both = settle(
        edges.select(F.col("a_cell").alias("src"), F.col("b_cell").alias("dst"))
        .union(edges.select("b_cell", "a_cell"))
        .distinct(),
        "edges",
    )
    labels = settle(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        offered = (
            both.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("near")), "dst")
            .groupBy("src")
            .agg(F.min("near").alias("near"))
            .withColumnRenamed("src", "node")
        )
        hooked = labels.join(offered, "node", "left").withColumn("best", F.least("label", F.coalesce("near", "label")))
        # A component follows its root: the root takes the smallest label any member was offered.
        roots = hooked.groupBy("label").agg(F.min("best").alias("root_best"))
        moved = hooked.join(roots, "label").select("node", "label", F.col("root_best").alias("target"))
        targets = moved.select(F.col("node").alias("target"), F.col("target").alias("beyond"))
        jumped = moved.join(targets, "target", "left").select(
            "node", F.col("label").alias("old"), F.least("target", F.coalesce("beyond", "target")).alias("label")
        )
        jumped = settle(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def dbscan(points: DataFrame, key: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(key, is_core, cluster): clusters numbered from 0 by their smallest core key, noise -1.

    A border point joins the cluster with the smallest number among the core points within eps. Rows without a place are noise.
    """
    side = eps / np.sqrt(2.0)
    places = settle(dbscan_cores(points, key, eps, min_samples), "cores")
    cores = places.where("is_core")
    nodes = cores.select(F.concat_ws(":", "cx", "cy").alias("node")).distinct()
    labels = connected_labels(nodes, _linked_cells(cores, eps, side))
    named = cores.withColumn("node", F.concat_ws(":", "cx", "cy")).join(labels, "node")
    firsts = named.groupBy("label").agg(F.min("first").alias("first_key"))
    numbers = dense_index(firsts, "first_key", "cluster").select("label", "cluster")
    core_cells = settle(
        named.groupBy("node", "cx", "cy", "label").agg(F.count(F.lit(1)).alias("n")).join(numbers, "label").select("node", "cx", "cy", "cluster"),
        "numbered",
    )
    core_rows = named.join(core_cells.select("node", "cluster"), "node").select("x", "y", "cluster")
    border = places.where(~F.col("is_core"))
    salts = 8
    asking = border.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.inline(_around(F.col("cx"), F.col("cy"))))
    asking = asking.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(salts)])))
    offered = (
        cores.join(core_cells.select("cx", "cy", "cluster"), ["cx", "cy"])
        .select("x", "y", "cx", "cy", "cluster", F.pmod(F.hash("x", "y"), F.lit(salts)).alias("salt"))
    )
    reached = (
        asking.join(offered, ["cx", "cy", "salt"])
        .where(_squared(F.col("qx"), F.col("qy"), F.col("x"), F.col("y")) <= eps * eps)
        .groupBy("qx", "qy")
        .agg(F.min("cluster").alias("cluster"))
        .withColumnsRenamed({"qx": "x", "qy": "y"})
    )
    known = core_rows.withColumn("is_core", F.lit(True)).unionByName(reached.withColumn("is_core", F.lit(False)))
    joined = placed_rows(points, key).join(known, ["x", "y"], "left")
    return joined.select(
        key, F.coalesce("is_core", F.lit(False)).alias("is_core"), F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster")
    )


# ---------------------------------------------------------------------------------------------------------------------
# Exact nearest neighbours and the local outlier factor
# ---------------------------------------------------------------------------------------------------------------------

NEIGHBOUR = "qx double, qy double, x double, y double, w bigint, d double"


def _cuts(low: Column, high: Column, quantiles: Column) -> Column:
    """The values a cell may be cut after: all lie below its largest, so both sides of a cut hold places."""
    some = F.array_distinct(F.concat(F.array(low), F.filter(quantiles, lambda e: e < high)))
    return F.when(low < high, some).otherwise(F.array().cast("array<double>"))


def _leaves(places: DataFrame, leaf_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Cut the plane until no leaf holds more than ``leaf_rows`` distinct places, whatever values repeat on an axis.

    Each round cuts every larger cell into up to ``FANOUT`` slabs along the axis with more distinct quantiles, or the wider one. Places of a cell differ,
    so at most one axis can repeat a value for over half of them, and the number of rounds grows with the logarithm of the places. Returns the places with
    their ``leaf`` and ``cap``, the distance to the far corner of the last cell that was cut, and the cells of every round below the root:
    (parent, leaf, closed, x0, x1, y0, y1). A cell's name starts with its parent's.
    """
    grid = F.array(*[F.lit(i / FANOUT) for i in range(1, FANOUT)])
    rest = places.withColumns({"leaf": F.lit("0"), "cap": F.lit(float("inf"))})
    closed, levels = [], []
    while True:
        edges = {f"{c}s": F.percentile_approx(c, grid, F.lit(2000)) for c in "xy"}
        sides = {f"{c}{i}": f(c) for c in "xy" for i, f in enumerate((F.min, F.max))}
        cells = rest.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in (sides | edges).items()])
        cuts = {f"{c}s": _cuts(F.col(f"{c}0"), F.col(f"{c}1"), F.col(f"{c}s")) for c in "xy"}
        cells = settle(cells.withColumns(cuts).withColumn("closed", F.col("n") <= leaf_rows), "cells")
        if closed:  # below the root
            parent = F.expr("substring(leaf, 1, length(leaf) - length(substring_index(leaf, '.', -1)) - 1)")
            levels.append(cells.select(parent.alias("parent"), "leaf", "closed", *sides))
        large = cells.where(~F.col("closed"))
        closed.append(rest.join(cells.where("closed"), "leaf", "left_semi"))
        if large.isEmpty():
            break
        by_x = (F.size("xs") > F.size("ys")) | ((F.size("xs") == F.size("ys")) & (F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")))
        slabs = F.least(F.lit(FANOUT), F.ceil(2 * F.col("n") / leaf_rows), F.size("cut") + 1).cast("int")
        thinned = F.transform(F.sequence(F.lit(1), F.col("slabs") - 1), lambda i: F.element_at("cut", F.floor(i * (F.size("cut") + 1) / F.col("slabs")).cast("int")))
        plan = large.withColumns({"by_x": by_x, "cut": F.when(by_x, F.col("xs")).otherwise(F.col("ys"))}).withColumn("slabs", slabs).withColumn("cut", thinned)
        wide = F.greatest(F.col("x") - F.col("x0"), F.col("x1") - F.col("x"))
        high = F.greatest(F.col("y") - F.col("y0"), F.col("y1") - F.col("y"))
        slab = F.size(F.filter("cut", lambda e: e < F.when(F.col("by_x"), F.col("x")).otherwise(F.col("y"))))
        split = rest.join(plan.select("leaf", "by_x", "cut", *sides), "leaf").withColumns(
            {"leaf": F.concat_ws(".", "leaf", slab.cast("string")), "cap": F.sqrt(wide * wide + high * high) * (1 + 1e-12)}
        )
        rest = settle(split.select(*places.columns, "leaf", "cap"), "split")
    leafed = closed[0]
    for part in closed[1:]:
        leafed = leafed.unionByName(part)
    return leafed, levels


def _nearest(qx, qy, x, y, w, k) -> list[tuple]:
    """The k nearest rows of each query among weighted places, as places; ties by coordinates.

    A place that is the query itself counts one row less. Only as many places as reach k rows are returned.
    """
    out = []
    for a, b in zip(qx, qy, strict=True):
        d2 = (x - a) ** 2 + (y - b) ** 2
        own = d2 == 0
        rows = np.where(own, w - 1, w)
        use = rows > 0
        xs, ys, ds, ws = x[use], y[use], d2[use], rows[use]
        if len(ds) > k:
            cut = np.partition(ds, k - 1)[k - 1]
            near = ds <= cut
            xs, ys, ds, ws = xs[near], ys[near], ds[near], ws[near]
        order = np.lexsort((ys, xs, ds))
        have = 0
        for i in order:
            if have >= k:
                break
            out.append((a, b, xs[i], ys[i], int(ws[i]), float(np.sqrt(ds[i]))))
            have += int(ws[i])
    return out


def nearest_places(places: DataFrame, k: int, leaf_rows: int = 512, chunk_rows: int = 2048) -> DataFrame:
    """(qx, qy, x, y, w, d): for every place the nearest places until they hold k rows, exactly.

    First each leaf is searched on its own, which bounds the k-th distance; in a leaf of fewer rows the cell above bounds it. Then the circles descend
    the cells round by round to the other leaves they meet. Leaves hold a bounded number of distinct places, and their queries come in chunks.
    """
    leafed, levels = _leaves(places.select("x", "y", "w"), max(leaf_rows, k + 1))
    leafed = settle(leafed, "leaves")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (pdf[c].to_numpy() for c in ("x", "y", "w"))
        rows = _nearest(x, y, x, y, w, k)
        return pd.DataFrame(rows, columns=["qx", "qy", "x", "y", "w", "d"])

    local = settle(leafed.groupBy("leaf").applyInPandas(inside, NEIGHBOUR), "local")
    if not levels:
        return _first_k_rows(local, k)
    reach = local.groupBy("qx", "qy").agg(F.sum("w").alias("have"), F.max("d").alias("r"))
    queries = leafed.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("leaf").alias("home"), "cap").join(reach, ["qx", "qy"], "left")
    radius = F.when(F.col("have") >= k, F.least("r", "cap")).otherwise(F.col("cap"))
    asked = queries.select("qx", "qy", "home", radius.alias("r"), F.lit("0").alias("parent"))
    met = []
    for cells in levels:
        below = cells.groupBy("parent").agg(F.collect_list(F.struct("leaf", "closed", "x0", "x1", "y0", "y1")).alias("cells"))
        gap_x = lambda c: F.greatest(F.lit(0.0), c["x0"] - F.col("qx"), F.col("qx") - c["x1"])
        gap_y = lambda c: F.greatest(F.lit(0.0), c["y0"] - F.col("qy"), F.col("qy") - c["y1"])
        # the slack keeps a place at exactly the radius, whose distance was rounded
        near = F.filter("cells", lambda c: (c["leaf"] != F.col("home")) & (gap_x(c) * gap_x(c) + gap_y(c) * gap_y(c) <= F.col("r") * F.col("r") * (1 + 1e-12)))
        found = asked.join(below, "parent").select("qx", "qy", "home", "r", F.explode(near).alias("c"))
        found = settle(found.select("qx", "qy", "home", "r", F.col("c.leaf").alias("leaf"), F.col("c.closed").alias("closed")), "met")
        met.append(found.where("closed").select("qx", "qy", "leaf"))
        asked = found.where("NOT closed").select("qx", "qy", "home", "r", F.col("leaf").alias("parent"))
    crossing = met[0]
    for part in met[1:]:
        crossing = crossing.unionByName(part)
    sizes = crossing.groupBy("leaf").agg(F.count(F.lit(1)).alias("q"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("q") / F.lit(chunk_rows))).cast("int")
    sized = sizes.withColumn("chunks", chunks).drop("q")
    asking = crossing.join(sized, "leaf").withColumn("chunk", F.pmod(F.hash("qx", "qy"), F.col("chunks")))
    asking = settle(asking.select("qx", "qy", "leaf", "chunk"), "asking")
    offered = leafed.join(sized, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def across(ask: pd.DataFrame, offer: pd.DataFrame) -> pd.DataFrame:
        rows = _nearest(
            ask["qx"].to_numpy(), ask["qy"].to_numpy(), offer["x"].to_numpy(), offer["y"].to_numpy(), offer["w"].to_numpy(), k
        )
        return pd.DataFrame(rows, columns=["qx", "qy", "x", "y", "w", "d"])

    foreign = (
        asking.groupBy("leaf", "chunk")
        .cogroup(offered.groupBy("leaf", "chunk"))
        .applyInPandas(across, NEIGHBOUR)
    )
    return _first_k_rows(local.unionByName(foreign), k)


def _first_k_rows(candidates: DataFrame, k: int) -> DataFrame:
    """Keep, per query, the nearest places until they hold k rows; the last one is cut to what is missing."""
    from pyspark.sql import Window

    order = Window.partitionBy("qx", "qy").orderBy("d", "x", "y")
    before = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = top_per_group(candidates, ["qx", "qy"], [F.col("d"), F.col("x"), F.col("y")], k, "_i").drop("_i")
    return (
        top.withColumn("_before", before)
        .where(F.col("_before") < k)
        .withColumn("w", F.least(F.col("w"), F.lit(k) - F.col("_before")))
        .drop("_before")
    )


def local_outlier_factor(points: DataFrame, key: str, k: int = 5, leaf_rows: int = 512) -> DataFrame:
    """(key, x, y, outlier_score): the local outlier factor over the k nearest other rows, ties in distance by coordinates.

    Every row stays: one without any other to compare with scores 1, one without a place has no score.
    """
    places = settle(locations(points, key).select("x", "y", "w"), "places")
    near = settle(nearest_places(places, k, leaf_rows), "near")
    reach = near.groupBy("qx", "qy").agg(F.max("d").alias("kd"), F.sum("w").alias("m"))
    kd = reach.select(F.col("qx").alias("x"), F.col("qy").alias("y"), "kd")
    reached = near.join(kd, ["x", "y"]).withColumn("rd", F.greatest("d", "kd"))
    lrd = settle(
        reached.groupBy("qx", "qy").agg((F.sum("w") / (F.sum(F.col("rd") * F.col("w")) + 1e-10 * F.sum("w"))).alias("lrd")), "lrd"
    )
    other = lrd.select(F.col("qx").alias("x"), F.col("qy").alias("y"), F.col("lrd").alias("other"))
    ratio = (
        near.join(other, ["x", "y"])
        .groupBy("qx", "qy")
        .agg((F.sum(F.col("other") * F.col("w")) / F.sum("w")).alias("mean_other"))
        .join(lrd, ["qx", "qy"])
        .select(F.col("qx").alias("x"), F.col("qy").alias("y"), (F.col("mean_other") / F.col("lrd")).alias("outlier_score"))
    )
    score = F.when(F.col("x").isNotNull(), F.coalesce("outlier_score", F.lit(1.0)))
    return placed_rows(points, key).join(ratio, ["x", "y"], "left").select(key, "x", "y", score.alias("outlier_score"))


# ---------------------------------------------------------------------------------------------------------------------
# Isolation forest
# ---------------------------------------------------------------------------------------------------------------------

EULER = 0.5772156649015329


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _grow(data: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """Nodes as [axis or -1, cut, left, right, path length of a leaf]."""
    nodes: list[list[float]] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1.0, 0.0, -1.0, -1.0, depth + float(_mean_path(np.array([len(rows)]))[0])])
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(2), np.zeros(2))
        split = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(split) == 0:
            return at
        axis = int(rng.choice(split))
        cut = float(rng.uniform(low[axis], high[axis]))
        goes = rows[:, axis] <= cut
        nodes[at][:2] = [float(axis), cut]
        nodes[at][2] = float(build(rows[goes], depth + 1))
        nodes[at][3] = float(build(rows[~goes], depth + 1))
        return at

    build(data, 0)
    return nodes


def isolation_scores(points: DataFrame, key: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(key, x, y, outlier_score) from trees grown on small random samples.

    A hash of row and tree decides which rows a tree sees: only rows under the threshold are repeated, and each tree
    keeps exactly the smallest ``sample`` hashes. Trees are a bounded table that every worker reads. Rows without a place have no score.
    """
    every = placed_rows(points, key)
    rows = every.where("x IS NOT NULL")
    n = rows.count()
    if n == 0:
        return every.withColumn("outlier_score", F.lit(None).cast("double"))
    chance = min(1.0, (sample + 8.0 * np.sqrt(sample) + 16.0) / n)
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    chosen = F.filter(numbers, lambda t: uniform_from_hash(F.col(key), t, F.lit(seed)) < chance)
    drawn = rows.select(key, "x", "y", F.explode(chosen).alias("tree")).withColumn(
        "_u", uniform_from_hash(F.col(key), F.col("tree"), F.lit(seed))
    )
    picked = top_per_group(drawn, ["tree"], [F.col("_u"), F.col(key)], min(sample, n))
    limit = int(np.ceil(np.log2(max(min(sample, n), 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        tree = int(pdf["tree"].iloc[0])
        nodes = _grow(pdf[["x", "y"]].to_numpy(), np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame({"tree": [tree], "nodes": [np.array(nodes).ravel()]})

    grown = picked.groupBy("tree").applyInPandas(grow, "tree int, nodes array<double>").orderBy("tree").collect()
    forest = points.sparkSession.sparkContext.broadcast([np.array(r["nodes"]).reshape(-1, 5) for r in grown])
    usual = float(_mean_path(np.array([min(sample, n)]))[0]) or 1.0

    @F.pandas_udf("double")
    def depth(xs: pd.Series, ys: pd.Series) -> pd.Series:
        data = np.column_stack([xs.to_numpy(), ys.to_numpy()])
        total = np.zeros(len(data))
        for nodes in forest.value:
            at = np.zeros(len(data), dtype=int)
            while True:
                inner = nodes[at, 0] >= 0
                if not inner.any():
                    break
                axis = nodes[at, 0].astype(int)
                value = data[np.arange(len(data)), np.maximum(axis, 0)]
                step = np.where(value <= nodes[at, 1], nodes[at, 2], nodes[at, 3]).astype(int)
                at = np.where(inner, step, at)
            total += nodes[at, 4]
        return pd.Series(total / max(1, len(forest.value)))

    score = F.pow(F.lit(2.0), -depth("x", "y") / F.lit(usual))
    return every.withColumn("outlier_score", F.when(F.col("x").isNotNull(), score))
