"""Row-local features and scores: a text's terms are counted inside its own task and looked up in a shared table, so nothing is shuffled.

Terms are counted by ``functions.cells`` in pieces of bounded size and found in the terms of a vocabulary. The table is broadcast, which the caller's
vocabulary cap bounds and ``LOCAL_BYTES`` checks; beyond it the join form of ``classify`` is used. The scores hold for batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from surveyloom.functions.cells import LENGTHS, cells, letters, source
from surveyloom.functions.numbers import softmax

#: Largest table of terms, idf and weights that is broadcast.
LOCAL_BYTES = 256 << 20


@dataclass
class TermTable:
    """A vocabulary: place, idf and, for scoring, one weight per class of every term."""

    terms: pa.Array
    places: np.ndarray
    idf: np.ndarray
    weights: np.ndarray | None = None


def term_table(vocab: DataFrame, classes: int = 0) -> TermTable | None:
    """The table of a vocabulary (term, idx, idf and, with ``classes``, w); None where it would exceed ``LOCAL_BYTES``."""
    size = vocab.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    if size["n"] * 8 * (3 + classes) + size["bytes"] > LOCAL_BYTES:
        return None
    rows = vocab.select("term", F.col("idx").cast("int").alias("idx"), "idf", *(["w"] if classes else [])).toArrow()
    weights = pc.list_flatten(rows["w"]).to_numpy().astype(float).reshape(len(rows), classes) if classes else None
    return TermTable(rows["term"].combine_chunks().cast(pa.string()), rows["idx"].to_numpy().astype(np.int32), rows["idf"].to_numpy().astype(float), weights)


def known_cells(
    batch: pa.Array, family: str, table: TermTable, low: int, high: int, known: Broadcast | None, sublinear: bool = True, normalize: bool = True
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces (first row, end row, row from the first, place in the table, count, weight) of the known terms, by row and number of the term."""
    seen, at = None, None
    for first, end, terms, row, term, tf in cells(batch, family, low, high, known):
        if terms is not seen:
            seen, at = terms, pc.index_in(terms, value_set=table.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place = at[term] if len(term) else term
        held = place >= 0
        row, place, tf = row[held], place[held], tf[held]
        order = np.lexsort((table.places[place], row))
        row, place, tf = row[order], place[order], tf[order]
        weight = (np.log(tf) + 1.0 if sublinear else tf.astype(float)) * table.idf[place]
        if normalize:
            weight = weight / np.sqrt(np.bincount(row, weight * weight, end - first))[row]
        yield first, end, row, place, tf, weight


def _lists(row: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    """One list per row of values that are ordered by row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def by_pieces(df: DataFrame, text: str, family: str, added: str, make: Callable[[pa.Array], Iterator[tuple[int, int, list[pa.Array]]]]) -> DataFrame:
    """Adds the columns ``added`` that ``make`` returns for pieces of a batch; each piece leaves its task at once, so a task never holds a batch of results."""
    kept = df.schema
    out = StructType([*kept.fields, *StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.columns[:-1]
            for first, end, columns in make(batch.column(len(own))):
                yield pa.RecordBatch.from_arrays([*[c.slice(first, end - first) for c in own], *columns], names=out.names)

    return df.withColumn("_source", source(F.col(text))).mapInArrow(run, out)


def with_bags(df: DataFrame, text: str, family: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Adds ``terms``: every distinct term of the row's text and how often it occurs."""
    low, high = low or LENGTHS[family][0], high or LENGTHS[family][1]
    known = letters(df.sparkSession, family)

    def make(batch: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for first, end, terms, row, term, tf in cells(batch, family, low, high, known):
            entries = pa.StructArray.from_arrays([terms.take(pa.array(term)), pa.array(tf.astype(np.int64))], names=["term", "tf"])
            yield first, end, [_lists(row, end - first, entries)]

    return by_pieces(df, text, family, "terms array<struct<term: string, tf: bigint>>", make)


def counted_terms(df: DataFrame, text: str, family: str) -> DataFrame:
    """(term, total, df): occurrences of every term and the number of rows with it, added up per piece of a batch before they are shuffled."""
    low, high = LENGTHS[family]
    known = letters(df.sparkSession, family)

    def counts(terms: pa.Array, total: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        held = np.flatnonzero(rows)
        return pa.RecordBatch.from_arrays([terms.take(pa.array(held)), pa.array(total[held]), pa.array(rows[held])], names=["term", "total", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = None
            for _, _, terms, _, term, tf in cells(batch.column(0), family, low, high, known):
                if terms is not seen:
                    if seen is not None:
                        yield counts(seen, total, rows)
                    seen, total, rows = terms, np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
                rows += np.bincount(term, minlength=len(terms))
                total += np.bincount(term, tf, len(terms)).astype(np.int64)
            if seen is not None:
                yield counts(seen, total, rows)

    parts = df.select(source(F.col(text))).mapInArrow(run, "term string, total bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def with_entries(df: DataFrame, text: str, family: str, table: TermTable, sublinear: bool = True, normalize: bool = True) -> DataFrame:
    """Adds ``entries``: term, idx, tf and weight of the known terms of every text."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    low, high = LENGTHS[family]
    known = letters(df.sparkSession, family)

    def make(batch: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        own = shared.value
        for first, end, row, place, tf, weight in known_cells(batch, family, own, low, high, known, sublinear, normalize):
            parts = [own.terms.take(pa.array(place)), pa.array(own.places[place]), pa.array(tf.astype(np.int64)), pa.array(weight)]
            yield first, end, [_lists(row, end - first, pa.StructArray.from_arrays(parts, names=["term", "idx", "tf", "weight"]))]

    return by_pieces(df, text, family, "entries array<struct<term: string, idx: int, tf: bigint, weight: double>>", make)


def local_rows(df: DataFrame, text: str, family: str, table: TermTable, sublinear: bool = True) -> DataFrame:
    """Adds ``indices`` and ``values``: the unit-length TF-IDF row of every text, empty without a known term."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    low, high = LENGTHS[family]
    known = letters(df.sparkSession, family)

    def make(batch: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for first, end, row, place, _, weight in known_cells(batch, family, shared.value, low, high, known, sublinear):
            yield first, end, [_lists(row, end - first, pa.array(v)) for v in (shared.value.places[place], weight)]

    return by_pieces(df, text, family, "indices array<int>, values array<double>", make)


def local_counts(df: DataFrame, text: str, family: str, table: TermTable) -> DataFrame:
    """Adds ``indices`` and ``counts``: the known terms of every text and how often they occur. Small integers take a fifth of the disk that weights do."""
    shared = df.sparkSession.sparkContext.broadcast(table)
    low, high = LENGTHS[family]
    known = letters(df.sparkSession, family)

    def make(batch: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for first, end, row, place, tf, _ in known_cells(batch, family, shared.value, low, high, known, normalize=False):
            yield first, end, [_lists(row, end - first, pa.array(v)) for v in (shared.value.places[place], tf.astype(np.int32))]

    return by_pieces(df, text, family, "indices array<int>, counts array<int>", make)


#: Rows of counts that are weighed at once.
WEIGHED = 512


def _weighed(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a batch whose last columns are ``indices`` and ``counts``: its rows, ends of their cells, row, place and unit-length weight of each cell."""
    for at in range(0, len(batch), WEIGHED):
        piece = batch.slice(at, WEIGHED)
        indices, counts = piece.columns[-2:]
        size = indices.value_lengths().to_numpy(zero_copy_only=False)
        row, ends = np.repeat(np.arange(len(piece)), size), np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        place = indices.flatten().to_numpy(zero_copy_only=False)
        weight = (np.log(counts.flatten().to_numpy(zero_copy_only=False)) + 1.0) * idf[place]
        yield piece, ends, row, place, weight / np.sqrt(np.bincount(row, weight * weight, len(piece)))[row]


def by_place(table: TermTable, values: np.ndarray) -> np.ndarray:
    """Values of the terms, in the order of their numbers."""
    out = np.zeros((int(table.places.max(initial=-1)) + 1, *values.shape[1:]))
    out[table.places] = values
    return out


def count_vectors(rows: DataFrame, table: TermTable, size: int) -> DataFrame:
    """Rows of :func:`local_counts` with ``features``, the vectors of :func:`local_rows` for pyspark.ml, in place of their counts; nothing is stored."""
    kept = rows.schema.fields[:-2]
    shared = rows.sparkSession.sparkContext.broadcast(by_place(table, table.idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, ends, _, place, weight in _weighed(batch, shared.value):
                n = len(piece)
                parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *[pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (place, weight)]]
                vector = pa.StructArray.from_arrays(parts, names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*piece.columns[:-2], vector], names=[*[f.name for f in kept], "features"])

    return rows.mapInArrow(run, StructType([*kept, StructField("features", VectorUDT())]))


def count_logits(rows: DataFrame, table: TermTable, intercepts: list[float]) -> DataFrame:
    """Rows of :func:`local_counts` with ``logits``, one number per column of the table's weights, in place of their counts."""
    kept = rows.schema.fields[:-2]
    out = StructType([*kept, *StructType.fromDDL("logits array<double>").fields])
    shared = rows.sparkSession.sparkContext.broadcast((by_place(table, table.idf), by_place(table, table.weights), np.array(intercepts, float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, w, bias = shared.value
        for batch in batches:
            for piece, _, row, place, weight in _weighed(batch, idf):
                found = np.stack([np.bincount(row, weight * w[place, c], len(piece)) + bias[c] for c in range(len(bias))], axis=1)
                logits = pa.ListArray.from_arrays(pa.array((np.arange(len(piece) + 1) * len(bias)).astype(np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-2], logits], names=out.names)

    return rows.mapInArrow(run, out)


def local_logits(df: DataFrame, text: Column, family: str, table: TermTable, intercepts: list[float]) -> Column:
    """A column of one number per class: the intercepts plus weights times unit-length TF-IDF."""
    shared = df.sparkSession.sparkContext.broadcast((table, np.array(intercepts, float)))
    low, high = LENGTHS[family]
    known = letters(df.sparkSession, family)

    @F.arrow_udf("array<double>")
    def add_up(batch: pa.Array) -> pa.Array:
        terms, bias = shared.value
        out = np.tile(bias, (len(batch), 1))
        for first, end, row, place, _, weight in known_cells(batch, family, terms, low, high, known):
            for c in range(len(bias)):
                out[first:end, c] += np.bincount(row, weight * terms.weights[place, c], end - first)
        return pa.ListArray.from_arrays(pa.array((np.arange(len(batch) + 1) * len(bias)).astype(np.int32)), pa.array(out.ravel()))

    return add_up(source(text))


def predicted(logits: Column, classes: list[str]) -> dict[str, Column]:
    """Columns pred, conf and probabilities of a column of logits; ties go to the first class."""
    chances = softmax(logits)
    names = F.array(*[F.lit(c) for c in classes])

    def best(p: Column) -> Column:
        top = F.array_max(p)
        return F.struct(F.element_at(names, F.array_position(p, top).cast("int")).alias("pred"), top.alias("conf"), p.alias("probabilities"))

    chosen = F.transform(F.array(chances), best)[0]
    return {c: chosen[c] for c in ("pred", "conf", "probabilities")}
