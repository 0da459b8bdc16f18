"""Benchmark decontamination by a prefix-filtered set join.

Every window of ``width`` consecutive words of a benchmark item (the whole item where it is shorter) is looked for in every document. Words are
ordered by how often the corpus holds them. A document that contains a window contains its rarest word, so one word a window is the
necessary prefix: only those words are joined with the documents' words. Each meeting places the item against the document; places at which
no window fits are dropped by length and position; the rest are verified word by word, over windows of the item's size.

Built-in expressions only. Documents are exploded to (key, position, word) without their text; the benchmark side is broadcast while its
size, which is measured, is small, and joined by shuffle otherwise (adaptive execution splits frequent words then). The places to verify come
back to the document's row, so no row per window or per hit word is made.

Defined results: null and empty texts have no words and are clean; items without words are skipped; repeated documents get a row each; repeated
items count once by id; items without an id hit words but are not listed; very long texts are one row with an array of words; empty tables give clean
documents or no rows; other columns are not read, except by ``clean``, which keeps the ones it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.session import settle

WIDTH = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of benchmark words up to which they are broadcast.
BROADCAST_CHARS = 16 << 20


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, anything but ASCII letters and digits breaks, other characters do not."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BREAKS), "")


def _keyed(docs: DataFrame, columns: list[str]) -> DataFrame:
    own = docs.select(*columns)
    return own.withColumns({"_k1": F.xxhash64("doc_id", "text"), "_k2": F.xxhash64(F.lit("other"), "text", "doc_id")})


def _places(keyed: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """(_k1, _k2, places): per document the items that may lie in it, each with its words and the position of its first word."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("iw")).distinct()
    items = items.withColumn("n", F.size("iw")).where("n > 0")
    items = items.select("item_id", "iw", "n", F.least("n", F.lit(width)).alias("size"), F.xxhash64("item_id", "iw").alias("item"))
    items = settle(items, "items")
    item_words = items.select("item", "n", "size", F.posexplode("iw").alias("ip", "word"))
    chars = items.agg(F.sum(F.aggregate("iw", F.lit(0).cast("long"), lambda a, w: a + F.length(w) + 16))).first()[0] or 0
    small = F.broadcast if chars <= BROADCAST_CHARS else (lambda df: df)

    vocabulary = small(item_words.select("word").distinct())
    spread = keyed.select("_k1", "_k2", words(F.col("text")).alias("w"))
    counts = spread.select(F.explode("w").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    rarity = item_words.join(counts, "word", "left").select("item", "n", "size", F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word", "ip").alias("r"))
    # one row per item: its words in order with their rarity; the rarest of each window is its prefix
    ranked = rarity.groupBy("item", "n", "size").agg(F.array_sort(F.collect_list(F.struct("r.ip", "r"))).alias("rs"))
    prefix = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda s: F.array_min(F.transform(F.slice("rs", s + 1, F.col("size")), lambda x: x["r"])))
    prefix = ranked.select("item", "n", "size", F.explode(F.array_distinct(prefix)).alias("p"))
    prefix = prefix.where("p.often > 0").select("item", "n", "size", F.col("p.word").alias("word"), F.col("p.ip").alias("ip"))
    prefix = settle(prefix, "prefixes")

    met = spread.select("_k1", "_k2", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word")).join(small(prefix), "word")
    shift = F.col("pos") - F.col("ip")
    first = F.greatest(F.lit(0), F.col("ip") - F.col("size") + 1, -shift)
    last = F.least("ip", F.col("n") - F.col("size"), F.col("n_words") - F.col("size") - shift)
    placed = met.where(first <= last).select("_k1", "_k2", "item", shift.alias("shift")).distinct()
    with_words = placed.join(small(items.select("item", "item_id", "iw", "n", "size")), "item")
    return with_words.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("item_id", "iw", "n", "size", "shift")).alias("places"))


def _found(w: Column, place: Column) -> Column:
    """Starts, in the document, of the item's windows that occur at this place."""
    same = F.transform(F.sequence(F.lit(0), place["n"] - 1), lambda i: F.coalesce(F.get(w, place["shift"] + i) == F.get(place["iw"], i), F.lit(False)))
    starts = lambda e: F.filter(F.sequence(F.lit(0), place["n"] - place["size"]), lambda s: F.forall(F.slice(e, s + 1, place["size"]), lambda x: x))
    bound = F.transform(F.array(same), lambda e: F.transform(starts(e), lambda s: s + place["shift"]))  # the comparison is made once
    return F.element_at(bound, 1)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, width: int = WIDTH, share: int = 20) -> DataFrame:
    """n_words, n_hit, item_ids (sorted as strings) and contaminated (a ``share``-th of the words or more are hit) beside the columns to keep."""
    keep = keep or ["doc_id"]
    keyed = _keyed(docs, list(dict.fromkeys([*keep, "doc_id", "text"])))
    places = settle(_places(keyed, benchmark, width), "places")
    joined = keyed.join(places, ["_k1", "_k2"], "left").select(*keep, words(F.col("text")).alias("_w"), "places")
    found = F.transform("places", lambda p: F.struct(p["item_id"].alias("item_id"), p["size"].alias("size"), _found(F.col("_w"), p).alias("at")))
    found = F.filter(found, lambda f: F.size(f["at"]) > 0)
    joined = joined.select(*keep, F.size("_w").alias("n_words"), F.when(F.col("places").isNotNull(), found).alias("_f"))
    hit = F.array_distinct(F.flatten(F.transform("_f", lambda f: F.flatten(F.transform(f["at"], lambda s: F.sequence(s, s + f["size"] - 1))))))
    names = F.array_sort(F.array_distinct(F.filter(F.transform("_f", lambda f: f["item_id"]), lambda x: x.isNotNull())))
    out = joined.select(
        *keep,
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.size(hit), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(names, F.array().cast("array<string>")).alias("item_ids"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    """The documents that are not contaminated.

    The verdicts are written before they are filtered: the optimiser would move the filter below the words' array and split the text again for each comparison.
    """
    judged = settle(contamination(docs, benchmark, columns).select(*columns, "contaminated"), "judged")
    return judged.where("not contaminated").select(*columns)
