"""SimHash fingerprints of documents and all pairs of them within a Hamming radius.

The terms of a text are its character shingles, lower-cased and padded at both ends, so that short texts share the ends they have in common. A term's
weight is ``1 + ln(occurrences)``; its hash votes with that weight for or against each bit of the fingerprint, and a bit is set where the votes for it prevail.
Two texts whose weighted terms enclose an angle ``a`` differ in ``a / pi`` of the bits on average, so ``cos(pi * share)`` estimates their cosine.

``classes`` finds every pair within a radius ``r``. The bits are cut into ``blocks > r`` blocks; two fingerprints that differ in at most ``r`` bits agree in
``blocks - r`` of them at least. For each choice of so many blocks there is a table in which the chosen blocks lead; fingerprints with equal leading blocks
are compared. Equal fingerprints are merged before. A crowded key is cut into parts by a hash, and pairs of parts are compared apart, so no key
is one task. A pair that meets in several tables counts in the first. Comparisons return at most one row per fingerprint, not pairs.

Defined results: a null text is empty; an empty text has no terms and the fingerprint of zero bits. Equal texts have equal fingerprints. Rows
without a doc_id are last in the order of documents and count as links of equal fingerprints only; their class is null where no equal fingerprint has an id.
Rows that share a doc_id are rows of their own; equal rows come in any order, which changes nothing. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from surveyloom.llm.common import chunks, components, id_and_text, labels_of_graph, sorted_runs
from surveyloom.llm.shingles import BASE, mix
from surveyloom.session import settle

BITS = 128
WIDTH = 7
RADIUS = 3
BLOCKS = 4
#: Terms whose votes are counted in one go.
TERMS = 1 << 16
#: Fingerprints of one key that are compared in one go.
PART = 512


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """For each value of a byte, +1 or -1 for each of its bits."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1


def term_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of all character shingles of a text, padded with ``width - 1`` zeros at both ends; none for an empty text."""
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(low):
        return np.empty(0, np.uint64)
    c = np.zeros(len(low) + 2 * (width - 1), np.uint64)
    c[width - 1 : width - 1 + len(low)] = low.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(low) + width - 1, np.uint64)
    for k in range(width):
        h *= np.uint64(BASE)
        h += c[k : k + len(h)]
    return mix(h)


def fingerprint(text: str, bits: int = BITS, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of a text as ``bits / 64`` unsigned words."""
    words = bits // 64
    h = np.sort(term_hashes(text, width))
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(h)])
    h = h[first]
    votes = np.zeros((words * 8, 8))
    lane = (np.arange(words * 8) * 256)[None, :]
    for a in range(0, len(h), TERMS):
        part = h[a : a + TERMS]
        spread = np.stack([part if w == 0 else mix(part ^ np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64))) for w in range(words)], axis=1)
        value = (spread.view(np.uint8).reshape(len(part), words * 8) + lane).ravel()
        some = count[a : a + TERMS]
        weight = None if some.max() == 1 else np.repeat(1.0 + np.log(some), words * 8)
        votes += np.bincount(value, weight, words * 8 * 256).reshape(words * 8, 256) @ _signs()
    return np.packbits(votes.ravel() > 0).view(np.uint64)


def as_hex(words: np.ndarray) -> str:
    return words.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated cosine of two texts' weighted terms, 0 where it would be negative."""
    share = int(np.bitwise_count(a ^ b).sum()) / (64 * len(a))
    return max(0.0, float(np.cos(np.pi * share)))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint) of every document; the fingerprint as lower-case hex."""
    rows = id_and_text(docs, id_column, text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, ["doc_id", "text"]):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids), "fingerprint": pa.array([as_hex(fingerprint(t or "", bits, width)) for t in texts])})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as many of the first code points of ``following``, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def beside_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """Each document, its edited text and the next document by descending id (the first after the last), compared by fingerprint.

    One range sort makes neighbours of consecutive documents. Only where a range ends does the next document lie in another task: the ranges'
    first and last documents, two per task, are joined afterwards.
    """
    rows = id_and_text(docs, id_column, text_column).withColumn("place", F.monotonically_increasing_id())
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text"), F.col("place")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    measured = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def measure(doc_id, text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
        new = edited(text, following)
        other = fingerprint(new, bits, width)
        digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, as_hex(own), as_hex(other), likeness(own, other), likeness(own, theirs)

    walked_schema = f"{measured}, end string, range int, text string"
    narrow, wide = (to_arrow_schema(StructType.fromDDL(s)) for s in (measured, walked_schema))

    def batch_of(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        last = None

        def edge(end: str, doc_id, text: str) -> pa.RecordBatch:
            return batch_of([(doc_id, *(None,) * 6, end, here, text)], wide)

        for ids, texts in chunks(batches, ["doc_id", "text"]):
            found = []
            for doc_id, text in zip(ids, texts, strict=True):
                text = text or ""
                own = fingerprint(text, bits, width)
                if last is None:
                    yield edge("first", doc_id, text)
                else:
                    found.append((*measure(*last, text, own), None, None, None))
                last = doc_id, text, own
            if found:
                yield batch_of(found, wide)
        if last is not None:
            yield edge("last", *last[:2])

    walked = settle(placed.mapInArrow(walk, walked_schema), "neighbours")
    ends = walked.where("end is not null")
    firsts = ends.where("end = 'first'").select("range", F.col("text").alias("following"))
    ranges = firsts.select("range")  # one row per task
    after = ranges.select("range", F.lead("range").over(Window.orderBy("range")).alias("next"))
    after = after.crossJoin(F.broadcast(ranges.agg(F.min("range").alias("least")))).select("range", F.coalesce("next", "least").alias("next"))
    open_rows = ends.where("end = 'last'").select("doc_id", "text", "range").join(after, "range")
    open_rows = open_rows.join(firsts.withColumnRenamed("range", "next"), "next").select("doc_id", "text", "following")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, follow in chunks(batches, ["doc_id", "text", "following"]):
            found = [measure(i, t, fingerprint(t, bits, width), f, fingerprint(f, bits, width)) for i, t, f in zip(ids, texts, follow, strict=True)]
            yield batch_of(found, narrow)

    return walked.where("end is null").select(*narrow.names).unionByName(open_rows.mapInArrow(close, measured))


def leading(words: np.ndarray, table: tuple[int, ...], blocks: int) -> np.ndarray:
    """The bits of a table's blocks, the others zero."""
    return words & _masks(words.shape[1], blocks)[list(table)].sum(axis=0, dtype=np.uint64)


@lru_cache(maxsize=8)
def _masks(words: int, blocks: int) -> np.ndarray:
    edges = np.linspace(0, words * 64, blocks + 1).round().astype(int)
    bits = np.zeros((blocks, words * 64), np.uint8)
    for k in range(blocks):
        bits[k, edges[k] : edges[k + 1]] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def classes(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """(fingerprint, n_links, class_id) of each distinct fingerprint of ``prints`` (doc_id, fingerprint).

    ``n_links`` counts the rows within ``radius`` bits of a row with this fingerprint, itself not included; ``class_id`` is the smallest doc_id that
    links of such rows reach.
    """
    tables = list(combinations(range(blocks), blocks - radius))
    merged = prints.groupBy("fingerprint").agg(F.min(F.col("doc_id").cast("long")).alias("id"), F.count(F.lit(1)).alias("copies"))
    merged = settle(merged, "fingerprints")

    def enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _words(batch.column("fingerprint"))
            for t, table in enumerate(tables):
                key = np.full(len(words), (t + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
                for w in leading(words, table, blocks).T:
                    key = mix(key ^ w)
                at = np.full(len(words), t, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(at), *(batch.column(c) for c in ("id", "copies", "fingerprint"))], names=["key", "t", "id", "copies", "fingerprint"])

    named = merged.where("id is not null").select("id", "copies", "fingerprint")
    entries = settle(named.mapInArrow(enter, "key long, t int, id long, copies long, fingerprint string"), "block-tables")
    crowd = entries.groupBy("key", "t").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("key", "t", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    live = entries.join(crowd, ["key", "t"]).withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    live = live.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("parts", "other")
    live = live.repartition("key", "t", "i", "j").sortWithinPartitions("key", "t", "i", "j")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_runs(batches, ["key", "t", "i", "j"]):
            found = _links(group, radius, tables, blocks)
            if found is not None:
                yield pa.RecordBatch.from_pydict(dict(zip(("fingerprint", "id", "links", "root"), found, strict=True)))

    linked = settle(live.mapInArrow(compare, "fingerprint string, id long, links long, root long"), "fingerprint-links")
    links = linked.groupBy("fingerprint").agg(F.sum("links").alias("links"))
    component = components(linked.where("id <> root"), "id", "root").withColumnRenamed("id", "node")
    out = merged.join(links, "fingerprint", "left").join(component, F.col("id") == F.col("node"), "left")
    return out.select("fingerprint", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("class_id"))


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    text = column.to_pylist()
    return np.frombuffer(bytes.fromhex("".join(text)), np.uint64).reshape(len(text), -1)


def _links(group: pa.Table, radius: int, tables: list[tuple[int, ...]], blocks: int) -> tuple | None:
    if group.num_rows < 2:
        return None
    words = _words(group["fingerprint"])
    ids, copies, part = (group[c].to_numpy() for c in ("id", "copies", "part"))
    t, i, j = (group[c][0].as_py() for c in ("t", "i", "j"))
    apart = np.zeros((len(ids), len(ids)), np.uint8)
    for w in words.T:
        apart += np.bitwise_count(w[:, None] ^ w[None, :])
    hit = np.triu(apart <= radius, 1)
    if i != j:
        hit &= part[:, None] != part[None, :]
    a, b = np.nonzero(hit)
    if not len(a):
        return None
    counted = np.ones(len(a), bool)
    for earlier in tables[:t]:  # a pair counts in the first table it meets in
        lead = leading(words, earlier, blocks)
        counted &= (lead[a] != lead[b]).any(axis=1)
    links = np.bincount(a[counted], copies[b[counted]], len(ids)) + np.bincount(b[counted], copies[a[counted]], len(ids))
    root = labels_of_graph(len(ids), a, b)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    show = np.bincount(np.r_[a, b], minlength=len(ids)) > 0
    return group["fingerprint"].combine_chunks().filter(pa.array(show)), ids[show], np.rint(links[show]).astype(np.int64), least[root[show]]
