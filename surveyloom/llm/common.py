"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.session import settle

#: Rows of a batch that are Python objects at a time.
ROWS_UNPACKED = 256

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Just the id and the text as ``doc_id`` and ``text``; whatever else the frame holds cannot clash with later names."""
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], columns: list[str], text: str = "text", limit: int = 4 << 20) -> Iterator[list[list]]:
    """Column lists of consecutive rows holding about ``limit`` characters of text each; one row may exceed it alone."""
    at = columns.index(text)
    for batch in batches:
        held: list[list] = [[] for _ in columns]
        size = 0
        for begin in range(0, batch.num_rows, ROWS_UNPACKED):  # Python objects of a whole batch would be several times its size
            part = batch.slice(begin, ROWS_UNPACKED)
            for row in zip(*(part.column(c).to_pylist() for c in columns), strict=True):
                for out, value in zip(held, row, strict=True):
                    out.append(value)
                size += len(row[at] or "")
                if size >= limit:
                    yield held
                    held, size = [[] for _ in columns], 0
        if held[0]:
            yield held


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches; at its end the worker, which waits for other tasks, returns its free memory to the system."""

    def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return tidy


#: Slots of a filter: its size does not depend on how many values it holds; the fuller it is, the more it lets through.
SLOTS = 1 << 24


def slots_of(frame: DataFrame, value: str) -> np.ndarray:
    """A filter of the 64-bit integers in a column, one bit per slot; as many numbers come to the driver as it has words, at most."""
    at = frame.select(F.pmod(F.col(value), F.lit(SLOTS)).cast("long").alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 31))")).alias("bits")).toPandas()
    out = np.zeros(SLOTS // 32, np.uint32)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def in_slots(slots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit integers may be in the filter; never False for one that is."""
    at = values.astype(np.int64) & (SLOTS - 1)
    return (slots[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Each text of ``docs`` that is not null once, as a table of ``text``.

    A filter of the digests of repeated texts tells which rows may have a copy. Only those are shuffled; each task merges its copies before.
    """
    keyed = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    keyed = keyed.withColumns({"d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit("other"), "text")})
    repeated = keyed.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slots = docs.sparkSession.sparkContext.broadcast(slots_of(repeated, "d1"))  # SLOTS bits

    def part(copied: bool) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_slots(slots.value, batch.column("d1").to_numpy(zero_copy_only=False)) == copied))

        return keyed.mapInArrow(released(run), keyed.schema)

    return part(False).select("text").unionByName(part(True).dropDuplicates(["d1", "d2"]).select("text"))


def crc_bucket(id_column: Column, n: int) -> Column:
    """crc32 of the id's text, modulo ``n``; null for a null id."""
    return F.crc32(id_column.cast("string")) % F.lit(n)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id on an edge: the smallest id it reaches.

    Alternates the large-star and small-star steps until the edges are stars around their smallest ids. Each step is a minimum per node
    (combined before the shuffle) and a join that adaptive execution may split, so a node with very many edges is no single task. Steps are
    written to the shared folder, which survives lost executors.
    """
    star = settle(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = star.select("u", "v").unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large, "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        small = settle(small, "small-star")
        if _digest(small) == _digest(star):
            break
        star = small
    leaves = star.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    centres = star.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(centres)


def _digest(edges: DataFrame) -> tuple:
    row = edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return tuple(row)


def labels_of_graph(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest node number each of ``n`` nodes reaches over the given edges."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal integer keys of a sorted stream; a run may cross batches."""
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
