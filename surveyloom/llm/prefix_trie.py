"""Prefix trie of conversations by truncation peeling.

Conversations are put in order and rebuilt (their head may come from another one), and each becomes rows of its prefixes: a 128-bit key, the exclusive
or of hashes of (depth, turn), so that the key of a parent is the key without the last turn. Equal conversations are merged to the smallest id with a count.

Peeling starts at the greatest depth. A level's survivors, one row per node with the sums of its subtree, meet the conversations that end there;
they are grouped by the key of their prefix, which makes the level's nodes; the last turn is stripped and the nodes, each represented by its smallest
member, are the survivors of the next level. Every node is found, and summed over its subtree, in the one step that reaches its depth.

A level that more than ``THIN`` distinct conversations reach is one distributed grouping, combined before its shuffle, so that a node of any size is no
single task. The deeper levels, which few conversations reach, are peeled in bands: a task takes all rows of as many levels as make ``BAND`` rows and
hands its top level on. No task, and nothing on the driver, holds more than these bounds; each level and band is written to the shared folder.
Positions, prefix keys and the list of the ids that end in a node are made by ranges and in pieces, so a conversation or a group of copies of any size is
many tasks; only the last digest over the pieces of one node is one stream.

Defined results: rows without a conv_id take no part; null roles and texts are empty; null turns come first, equal turns in the order of a digest of
role and text; repeated rows are turns of their own. A text counts as its words ``[^\\x20\\x09-\\x0D]+``. Any conversations, even turnless ones once rebuilt, give a root; an
empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.operators.ranks import ranked_in_group
from surveyloom.session import scratch_path, settle

#: A level that more distinct conversations reach is grouped by Spark.
THIN = 16_384
#: Rows of the deeper levels that one task peels at a time.
BAND = 65_536
#: Turns of one conversation whose keys are made in one go.
RUN = 1024
#: Ids that are joined to one piece of text.
PIECE = 4096

NODE = "k1 long, k2 long, p1 long, p2 long, depth long, conv long, n long, children long, leaves long, saved long, ends string"
EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, t1, t2, words): every turn's place in its conversation from 1, a 128-bit hash of role and text, and its number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").alias("turn"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("other"), role, text).alias("t2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("t1"), F.asc("t2")]
    placed = settle(turns.repartitionByRange(F.col("conv"), *order, F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()), "turns")
    return ranked_in_group(placed, ["conv"], F.col("range"), order, "pos").select("conv", F.col("pos").cast("long").alias("pos"), "t1", "t2", "words")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, total, t1, t2, words) of every rebuilt turn, and (conv, total) of every conversation.

    The first ``h`` turns of conversation ``c`` are those of ``c - c % every``, ``h = crc32(c) % heads``; its own follow from the one after ``h``.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    plan = sizes.withColumns({"base": F.expr(f"conv - conv % {every}"), "h": F.crc32(F.col("conv").cast("string")) % heads})
    plan = plan.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    plan = plan.withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("total", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = settle(plan.select("conv", "base", "h", "m", "total"), "plan")
    own = turns.join(plan, "conv").where("pos > h").select("conv", F.expr("m + pos - h").alias("depth"), "total", "t1", "t2", "words")
    first = turns.where(f"pos < {heads} and conv % {every} = 0").withColumnRenamed("conv", "base")
    taken = first.join(plan, "base").where("pos <= h").select("conv", F.col("pos").alias("depth"), "total", "t1", "t2", "words")
    return own.unionByName(taken), plan.select("conv", "total")


def prefix_rows(turns: DataFrame) -> DataFrame:
    """Adds the key (k1, k2) of the prefix that ends with a turn and the key (p1, p2) of the one before."""
    step = turns.withColumns({"f1": F.xxhash64("depth", "t1", "t2"), "f2": F.xxhash64(F.lit("other"), "depth", "t1", "t2"), "run": F.expr(f"(depth - 1) div {RUN}")})
    runs = step.groupBy("conv", "run").agg(F.bit_xor("f1").alias("x1"), F.bit_xor("f2").alias("x2"))
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("conv", "run", F.bit_xor("x1").over(before).alias("o1"), F.bit_xor("x2").over(before).alias("o2")).where("run > 0")
    inside = Window.partitionBy("conv", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = step.withColumns({"i1": F.bit_xor("f1").over(inside), "i2": F.bit_xor("f2").over(inside)}).join(offsets, ["conv", "run"], "left")
    keyed = keyed.withColumns({f"k{i}": F.col(f"i{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0))) for i in (1, 2)})
    parents = {f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"f{i}")) for i in (1, 2)}
    return keyed.withColumns(parents).select("conv", "depth", "total", "k1", "k2", "p1", "p2", "words")


def ended(ends: DataFrame) -> DataFrame:
    """(conv, copies, ends): of each group of equal conversations (k1, k2) the smallest id, the size, and the SHA-256 of all ids, sorted and comma-joined."""
    order = ["k1", "k2", "conv"]
    placed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in order]
            for (k1, k2), run in groupby(zip(*columns, strict=True), key=lambda r: r[:2]):
                ids = [r[2] for r in run]
                out += [(k1, k2, ids[a], len(ids[a : a + PIECE]), ",".join(map(str, ids[a : a + PIECE]))) for a in range(0, len(ids), PIECE)]
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("k1", "k2", "first", "n", "ids"), map(list, zip(*out, strict=True)), strict=True)))

    listed = placed.mapInArrow(pieces, "k1 long, k2 long, first long, n long, ids string")
    listed = listed.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, conv, copies, digest = None, 0, 0, hashlib.sha256()
        for batch in batches:
            out = []
            for k1, k2, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2) == last:
                    digest.update(b"," + ids.encode())
                    copies += n
                    continue
                if last is not None:
                    out.append((conv, copies, digest.hexdigest()))
                last, conv, copies, digest = (k1, k2), first, n, hashlib.sha256(ids.encode())
            if out:
                yield _columns(out, ("conv", "copies", "ends"))
        if last is not None:
            yield _columns([(conv, copies, digest.hexdigest())], ("conv", "copies", "ends"))

    return listed.mapInArrow(digests, "conv long, copies long, ends string")


def _columns(rows: list[tuple], names: Iterable[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))


def bands(totals: list[int], floor: int, size: int) -> list[tuple[int, int]]:
    """(low, high] ranges of the depths above ``floor``, deepest first, of at most ``size`` rows each (one level at least), from the totals of the
    conversations that reach beyond it. Depths between two totals hold equally many rows, so they are cut by division."""
    out: list[tuple[int, int]] = []
    totals = sorted((t for t in totals if t > floor), reverse=True)
    high = depth = totals[0] if totals else floor
    rows = alive = 0
    while depth > floor:
        while alive < len(totals) and totals[alive] >= depth:
            alive += 1
        low = max(totals[alive] if alive < len(totals) else floor, floor)
        levels = min(depth - low, max(0, size - rows) // alive)
        if levels == 0 and high > depth:
            out.append((depth, high))
            high, rows = depth, 0
            continue
        levels = max(levels, 1)
        depth -= levels
        rows += levels * alive
    if high > floor:
        out.append((floor, high))
    return out


def _level(rows: DataFrame, above: DataFrame | None) -> DataFrame:
    """Nodes of one depth from its prefix rows and the nodes of the next depth."""
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("string")
    fields = ["k1", "k2", "p1", "p2", "depth", "words", "conv"]
    found = rows.where("depth = total").select(*fields, F.col("copies").alias("n"), zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends")
    if above is not None:
        stripped = rows.select(*fields).join(above.select("conv", "n", "leaves", "saved"), "conv")
        found = found.unionByName(stripped.select(*fields, "n", F.lit(1).cast("long").alias("children"), "leaves", "saved", nothing.alias("ends")))
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    same = [F.min(c).alias(c) for c in ("p1", "p2", "depth", "words", "conv")]
    nodes = found.groupBy("k1", "k2").agg(*sums, *same, F.max("ends").alias("ends"))
    leaves = F.when(F.col("children") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long")
    return nodes.withColumns({"leaves": leaves, "saved": F.expr("saved + (n - 1) * words")}).select(*[f.split()[0] for f in NODE.split(", ")])


def _peel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for all depths of a band; its rows come deepest first, those of the nodes above it before all others."""
    alive: dict[int, tuple[int, int, int]] = {}
    out: list[tuple] = []
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in _BAND), strict=True))
    for depth, level in groupby(rows, key=lambda r: r[0]):
        nodes: dict[tuple[int, int], list] = {}
        for _, conv, total, k1, k2, p1, p2, words, copies, ends, n, leaves, saved in level:
            if n is not None:  # a node of the band before
                alive[conv] = n, leaves, saved
                continue
            arrived = [(copies, 0, 0, 0, ends)] if total == depth else []
            if conv in alive:
                n, leaves, saved = alive[conv]
                arrived.append((n, 1, leaves, saved, None))
            for n, child, leaves, saved, ends in arrived:
                node = nodes.setdefault((k1, k2), [conv, 0, 0, 0, 0, None, p1, p2, words])
                node[0] = min(node[0], conv)
                node[1:5] = [a + b for a, b in zip(node[1:5], (n, child, leaves, saved), strict=True)]
                node[5] = ends or node[5]
        if nodes:
            alive = {}
        for (k1, k2), (conv, n, children, leaves, saved, ends, p1, p2, words) in nodes.items():
            alive[conv] = n, leaves if children else 1, saved + (n - 1) * words
            out.append((k1, k2, p1, p2, depth, conv, n, children, *alive[conv][1:], ends))
    if out:
        fields = [f.split() for f in NODE.split(", ")]
        kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in fields]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[name for name, _ in fields])


_BAND = ["depth", "conv", "total", "k1", "k2", "p1", "p2", "words", "copies", "ends", "n", "leaves", "saved"]


def trie(conversations: DataFrame, every: int = 20, heads: int = 4, thin: int = THIN, band: int = BAND) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    spark: SparkSession = conversations.sparkSession
    turns, totals = rebuilt(ordered_turns(conversations), every, heads)
    rows = settle(prefix_rows(turns), "prefixes")
    bare = [F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "p1", "p2")]
    roots = totals.select("conv", F.lit(0).cast("long").alias("depth"), "total", *bare, F.lit(0).cast("long").alias("words"))
    rows = rows.unionByName(roots)
    kept = settle(ended(rows.where("depth = total")), "ended")
    mine = rows.join(kept, "conv")
    deepest = [r.total for r in totals.join(kept.select("conv"), "conv").orderBy(F.desc("total")).select("total").limit(thin + 1).collect()]
    widest = deepest[thin] if len(deepest) > thin else -1
    parts: list[DataFrame] = []
    above: DataFrame | None = None
    if deepest and deepest[0] > widest:
        narrow = settle(mine.where(F.col("depth") > widest).repartitionByRange("depth").sortWithinPartitions("depth"), "narrow")
        for low, high in bands(deepest, widest, band):
            here = narrow.where(f"depth > {low} and depth <= {high}").select(*_BAND[:10], *[F.lit(None).cast("long").alias(c) for c in _BAND[10:]])
            if above is not None:
                blank = [F.lit(None).cast("string" if c == "ends" else "long").alias(c) for c in _BAND[2:10]]
                here = here.unionByName(above.select(F.lit(high + 1).cast("long").alias("depth"), "conv", *blank, "n", "leaves", "saved"))
            peeled = here.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(_peel, NODE)  # a band has a bounded number of rows
            parts.append(settle(peeled, "band"))
            above = parts[-1].where(f"depth = {low + 1}")
    if widest >= 0:
        path = scratch_path(spark, "levels")
        spread = F.pmod(F.xxhash64("conv"), F.lit(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)))
        mine.where(F.col("depth") <= widest).withColumn("level", F.col("depth")).repartition("level", spread).write.partitionBy("level").parquet(path)
        for depth in range(widest, -1, -1):
            parts.append(settle(_level(spark.read.schema(mine.schema).parquet(f"{path}/level={depth}"), above), "level"))
            above = parts[-1]
    names = [f.split()[0] for f in NODE.split(", ")]
    nodes = spark.createDataFrame([], NODE)
    for part in parts:
        nodes = nodes.unionByName(part.select(*names))
    parents = nodes.where("children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    below = nodes.where("depth > 0").join(parents, ["p1", "p2"])
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(top.select(*below.columns)).select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
