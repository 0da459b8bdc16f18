"""TF-IDF in long form: (key, term, tf, weight) rows instead of a matrix.

Terms are counted inside a text's own task and kept as one array per key (a bag) until they must be rows, so neither (key, term) rows nor texts are
shuffled. Only keys that come more than once, and rows without a key, are merged by grouping. The vocabulary, whose size the caller caps, is the only table
that is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from surveyloom.operators.common import with_scalars
from surveyloom.operators.scoring import local_rows, term_table, with_bags, with_entries
from surveyloom.session import is_settled, scratch_path, settle, settle_at

MAX_BROADCAST_TERMS = 200_000
#: Rows of one term from which it is spread over several tasks.
HEAVY_TERM = 200_000


def by_key(df: DataFrame, key: str, local: Callable[[DataFrame], DataFrame], grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``local`` for the rows whose key is their own, and ``grouped`` for those that share a key or have none. Only keys are shuffled to tell them apart."""
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    shared = settle(keys.where((F.col("_rows") > 1) | F.col(key).isNull()).select(F.col(key).alias("_shared"), F.lit(True).alias("_again")), "shared-keys")
    if shared.isEmpty():
        return local(df)
    marked = df.join(shared, F.col(key).eqNullSafe(F.col("_shared")), "left")
    parts = [marked.where(c).select(*df.columns) for c in (F.col("_again").isNull(), F.col("_again").isNotNull())]
    return local(parts[0]).unionByName(grouped(parts[1]))


def term_bags(df: DataFrame, key: str, text: str, family: str, low: int | None = None, high: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, terms): the distinct terms of every key and how often they occur, as one array of (term, tf); no row for a key without any.

    The columns ``keep`` go along: rows that share a key have its terms in common, each with its own columns; without a key there is nothing to join them by.
    """

    def local(rows: DataFrame) -> DataFrame:
        return with_bags(rows, text, family, low, high).where(F.size("terms") > 0).select(key, *keep, "terms")

    def grouped(rows: DataFrame) -> DataFrame:
        cut = with_bags(rows.select(key, text), text, family, low, high).select(key, F.inline("terms"))
        merged = cut.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
        bags = merged.groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
        return (bags.join(rows.select(key, *keep), key) if keep else bags).select(key, *keep, "terms")

    return by_key(df.select(key, text, *keep), key, local, grouped)


def word_terms(df: DataFrame, key: str, text: str, low: int = 1, high: int = 2) -> DataFrame:
    """(key, term, tf) of lower-case word n-grams."""
    return term_bags(df, key, text, "tfidf", low, high).select(key, F.inline("terms"))


def char_terms(df: DataFrame, key: str, text: str, low: int = 2, high: int = 5) -> DataFrame:
    """(key, term, tf) of character n-grams inside padded words; a repeated word is cut up once per batch."""
    return term_bags(df, key, text, "char_ngram", low, high).select(key, F.inline("terms"))


TERM_FAMILIES = {"tfidf": word_terms, "char_ngram": char_terms}


def vocabulary(terms: DataFrame, key: str, max_features: int) -> DataFrame:
    """The most frequent terms of the corpus (ties by term), numbered, with their document counts."""
    return numbered_terms(terms.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")), max_features)


def numbered_terms(counts: DataFrame, max_features: int) -> DataFrame:
    """The same from a table of (term, total, df)."""
    kept = most_frequent(counts, max_features)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("total"), F.asc("term"))
    return kept.withColumn("idx", F.row_number().over(order) - 1)


def most_frequent(counts: DataFrame, k: int) -> DataFrame:
    """The k terms with the largest totals, ties by term.

    The total at which k terms are reached comes from the number of terms per total, a far smaller table; only terms with that very total are sorted.
    """
    counts = counts if is_settled(counts) else settle(counts, "term-counts")
    per_total = counts.groupBy("total").agg(F.count(F.lit(1)).alias("_terms"))
    largest = per_total.orderBy(F.desc("total")).limit(k)
    reached = F.sum("_terms").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("total")))
    edge = largest.withColumn("_reached", reached).where(F.col("_reached") - F.col("_terms") < k).agg(F.min("total"), F.max(F.col("_reached") - F.col("_terms"))).first()
    if edge[0] is None:
        return counts
    ties = counts.where(F.col("total") == edge[0]).orderBy("term").limit(k - edge[1])
    return counts.where(F.col("total") > edge[0]).unionByName(ties)


def join_terms(terms: DataFrame, table: DataFrame, rows: int | None = None) -> DataFrame:
    """Terms with their row of a term table: by broadcast while the table is small, else by a join whose frequent terms are spread.

    Terms in more than ``HEAVY_TERM`` rows are dealt by a salt, and only their rows of the table are repeated.
    """
    rows = table.count() if rows is None else rows
    if rows <= MAX_BROADCAST_TERMS:
        return terms.join(F.broadcast(table), "term")
    heavy = terms.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HEAVY_TERM)
    heavy = settle(heavy.select("term", F.ceil(F.col("_n") / HEAVY_TERM).cast("int").alias("_parts")), "heavy-terms")
    # at most one term in HEAVY_TERM rows is heavy; beyond a million of them the join is left to adaptive execution
    marked = F.broadcast(heavy) if heavy.count() <= 1_000_000 else heavy
    others = [c for c in terms.columns if c != "term"]
    salted = terms.join(marked, "term", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*others), F.col("_parts")), F.lit(0)).cast("int"))
    spread_table = table.join(marked, "term", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return salted.drop("_parts").join(spread_table.drop("_parts"), ["term", "_salt"]).drop("_salt")


def with_idf(vocab: DataFrame, documents: DataFrame) -> DataFrame:
    """Add idf = ln((1 + n) / (1 + df)) + 1 for the n documents the counts come from."""
    n = documents.agg(F.count(F.lit(1)).alias("_docs"))
    idf = F.log((F.lit(1.0) + F.col("_docs")) / (F.lit(1.0) + F.col("df"))) + 1.0
    return with_scalars(vocab, n).withColumn("idf", idf).drop("_docs")


def tfidf(terms: DataFrame, vocab: DataFrame, key: str, max_features: int, sublinear: bool = True, normalize: bool = True) -> DataFrame:
    """(key, term, idx, tf, weight): unit-length weights of the terms in the vocabulary.

    The length of a document is a sum over its own rows, at most one per vocabulary term.
    """
    tf = F.log(F.col("tf")) + 1.0 if sublinear else F.col("tf").cast("double")
    raw = join_terms(terms, vocab.select("term", "idx", "idf"), max_features).withColumn("_raw", tf * F.col("idf"))
    if not normalize:
        return raw.select(key, "term", "idx", "tf", F.col("_raw").alias("weight"))
    length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "idx", "tf", (F.col("_raw") / length).alias("weight"))


def tfidf_bags(
    df: DataFrame, key: str, text: str, family: str, vocab: DataFrame, max_features: int, sublinear: bool = True, normalize: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, keep, entries): :func:`tfidf` of every key as one array of (term, idx, tf, weight), made inside the row while the vocabulary may be broadcast."""
    table = term_table(vocab)

    def local(rows: DataFrame) -> DataFrame:
        return with_entries(rows, text, family, table, sublinear, normalize).where(F.size("entries") > 0).select(key, *keep, "entries")

    def grouped(rows: DataFrame) -> DataFrame:
        weights = tfidf(TERM_FAMILIES[family](rows, key, text), vocab, key, max_features, sublinear, normalize)
        bags = weights.groupBy(key).agg(F.collect_list(F.struct("term", "idx", "tf", "weight")).alias("entries"))
        return (bags.join(rows.select(key, *keep), key) if keep else bags).select(key, *keep, "entries")

    rows = df.select(key, text, *keep)
    return grouped(rows) if table is None else by_key(rows, key, local, grouped)


def sparse_texts(df: DataFrame, key: str, text: str, family: str, vocab: DataFrame, max_features: int, sublinear: bool = True) -> DataFrame:
    """:func:`sparse_rows` of the texts themselves, made inside the row while the vocabulary may be broadcast."""
    table = term_table(vocab)

    def grouped(rows: DataFrame) -> DataFrame:
        return sparse_rows(tfidf(TERM_FAMILIES[family](rows, key, text), vocab, key, max_features, sublinear), rows, key)

    rows = df.select(key, text)
    if table is None:
        return grouped(rows)
    return by_key(rows, key, lambda own: local_rows(own, text, family, table, sublinear).select(key, "indices", "values"), grouped)


def sparse_rows(weights: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """(key, indices, values) per document, empty arrays for a document without a known term."""
    entries = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("_entries"))
    joined = documents.select(key).join(entries, key, "left")
    return joined.select(
        key,
        F.coalesce(F.transform("_entries", lambda e: e["idx"]), F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.transform("_entries", lambda e: e["weight"]), F.array().cast("array<double>")).alias("values"),
    )


def vectors(rows: DataFrame, size: int, *keep, name: str = "features") -> DataFrame:
    """(keep, ``name``) for pyspark.ml. A sparse vector is stored as the struct of its parts and read back as a vector, all inside the engine."""
    parts = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("indices").cast("array<int>").alias("indices"), F.col("values").cast("array<double>").alias("values")
    )
    plain = rows.select(*keep, parts.alias(name))
    schema = StructType([*plain.schema.fields[:-1], StructField(name, VectorUDT())])
    return settle_at(plain, scratch_path(rows.sparkSession, "vectors"), schema)
