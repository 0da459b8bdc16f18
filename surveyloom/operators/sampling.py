"""Exact stratified splits, oversampling and permutation, fixed by a seed and independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.operators.ranks import dense_index, ranked_in_group
from surveyloom.session import release, settle

HASH_DIGITS = 3  # leading hex digits of the md5 that pick one of 4096 buckets


def seeded_digest(key: Column, seed: int) -> Column:
    """md5 of key and seed: any engine can reproduce the order."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def digest_rank(df: DataFrame, groups: list[str], key: str, seed: int, name: str) -> DataFrame:
    """1-based rank in the order of the seeded digest within each group, ties by key; buckets are leading digits."""
    hashed = df.withColumn("_digest", seeded_digest(F.col(key), seed))
    return _ranked(hashed, groups, [F.col("_digest"), F.col(key)], name).drop("_digest")


def _ranked(hashed: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    return ranked_in_group(hashed, groups, F.conv(F.substring("_digest", 1, HASH_DIGITS), 16, 10).cast("int"), order, name)


def _largest_remainder(strata: DataFrame, sizes: str, ratio: float, name: str) -> DataFrame:
    """Give ceil(ratio * total) places to the strata in proportion; left-over places go to the largest remainders.

    One row per stratum, so the windows are over a handful of rows.
    """
    whole = Window.partitionBy(F.lit(1))
    total = F.sum(sizes).over(whole)
    frame = strata.withColumn("_places", F.ceil(F.lit(ratio) * total)).withColumn(
        "_quota", F.col(sizes).cast("double") / total * F.col("_places")
    )
    frame = frame.withColumn("_base", F.floor("_quota")).withColumn("_part", F.col("_quota") - F.col("_base"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("_part"), F.asc("_stratum"))
    spare = F.col("_places") - F.sum("_base").over(whole)
    return (
        frame.withColumn("_order", F.row_number().over(order))
        .withColumn(name, F.col("_base") + F.when(F.col("_order") <= spare, 1).otherwise(0))
        .drop("_places", "_quota", "_base", "_part", "_order")
    )


#: Strata whose cuts are compared as constants.
STRATA = 256
#: Rows up to which shuffling them is cheaper than another pass to find the cuts.
FEW_ROWS = 20_000


def stratified_split(
    df: DataFrame,
    stratum: str = "sentiment_class",
    key: str = "survey_id",
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: the test part first, then validation from the rest, both with exact sizes per stratum.

    Rows without a stratum drop out. A stratum that holds most rows is still ranked in 4096 pieces. Only digests are ranked: a row then finds its part by
    comparing its own with the last ones of the parts, so rows are not shuffled. Of few rows, and where rows of one key lie on both
    sides of such a cut, whole rows are ranked and written.
    """
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError("ratios must sum to 1")
    rows = df.where(F.col(stratum).isNotNull()).withColumn("_stratum", F.col(stratum))
    strata = rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_size"))
    strata = _largest_remainder(strata, "_size", test, "_test")
    strata = _largest_remainder(strata.withColumn("_rest", F.col("_size") - F.col("_test")), "_rest", val / (train + val), "_val")
    known = strata.select("_stratum", "_size", "_test", "_val").limit(STRATA + 1).collect()
    sizes = {r["_stratum"]: (r["_test"], r["_test"] + r["_val"]) for r in known}
    if len(sizes) <= STRATA and sum(r["_size"] for r in known) > FEW_ROWS:
        digests = settle(rows.select("_stratum", seeded_digest(F.col(key), seed).alias("_digest")), "digests")
        cuts = F.create_map(*[x for s, ends in sizes.items() for x in (F.lit(s), F.array(*[F.lit(e) for e in ends]))])
        near = _ranked(digests, ["_stratum"], [F.col("_digest")], "_rank").withColumn("_ends", cuts[F.col("_stratum")])
        found = near.where(F.array_contains("_ends", F.col("_rank")) | F.array_contains("_ends", F.col("_rank") - 1)).collect()
        at = {(r["_stratum"], r["_rank"]): r["_digest"] for r in found}
        release(digests)
        if all(at.get((s, e)) is None or at[s, e] != at.get((s, e + 1)) for s, ends in sizes.items() for e in ends):
            last = F.create_map(*[x for s, ends in sizes.items() for x in (F.lit(s), F.array(*[F.lit(at.get((s, e), "")) for e in ends]))])
            own, ends = seeded_digest(F.col(key), seed), last[F.col(stratum)]
            part = F.when(own <= ends[0], "test").when(own <= ends[1], "val").otherwise("train")
            return rows.drop("_stratum").withColumn("split", part).select(*df.columns, "split")
    ranked = digest_rank(rows, ["_stratum"], key, seed, "_rank")
    sized = ranked.join(strata.select("_stratum", "_test", "_val"), "_stratum")
    part = (
        F.when(F.col("_rank") <= F.col("_test"), "test")
        .when(F.col("_rank") <= F.col("_test") + F.col("_val"), "val")
        .otherwise("train")
    )
    # which of a key's rows comes first is open, so it is settled once
    return settle(sized.withColumn("split", part).select(*df.columns, "split"), "split")


def split_overlaps(df: DataFrame, key: str = "survey_id", split: str = "split") -> DataFrame:
    """Number of ids per pair of splits they share; empty when nothing leaks. One row per id and split is shuffled."""
    ids = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(split).alias("_splits"))
    sorted_splits = F.array_sort("_splits")
    pairs = F.flatten(
        F.transform(
            sorted_splits,
            lambda a: F.transform(
                F.filter(sorted_splits, lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right"))
            ),
        )
    )
    return ids.where(F.size("_splits") > 1).select(F.inline(pairs)).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n_shared"))


def check_no_overlap(df: DataFrame, key: str = "survey_id", split: str = "split") -> None:
    found = split_overlaps(df, key, split).collect()
    if found:
        raise ValueError("splits share ids: " + ", ".join(f"{r['left']}/{r['right']}={r['n_shared']}" for r in found))


#: Draws of one row that may meet in one task.
DRAWS_PER_ROW = 100_000


def oversample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Repeat random rows of the smaller classes, with replacement, until all classes are as large as the largest.

    Extra draws are generated in parallel, each naming a row by its rank within the class, and joined to the ranked
    rows. ``draw`` is 0 for an original row and numbers the extra ones; ``shuffle_key`` gives a random order.
    """
    spark = df.sparkSession
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(sizes.values(), default=0)
    extra = {c: most - n for c, n in sorted(sizes.items(), key=lambda kv: str(kv[0])) if n < most}
    original = df.withColumn("draw", F.lit(0).cast("bigint"))
    if extra:
        upper, chosen = 0, F.lit(None)
        salts = {c: -(-n // (sizes[c] * DRAWS_PER_ROW)) for c, n in extra.items()}
        salt, wide = F.lit(1), F.lit(1)
        size, first = F.lit(1), F.lit(0)
        for c, n in extra.items():
            inside = (F.col("id") >= upper) & (F.col("id") < upper + n)
            chosen = F.when(inside, F.lit(c)).otherwise(chosen)
            size = F.when(inside, F.lit(sizes[c])).otherwise(size)
            first = F.when(inside, F.lit(upper)).otherwise(first)
            salt = F.when(inside, F.lit(salts[c])).otherwise(salt)
            wide = F.when(F.col(label) == F.lit(c), F.lit(salts[c])).otherwise(wide)
            upper += n
        draws = spark.range(upper).select(
            chosen.alias(label),
            (F.pmod(F.xxhash64(F.lit(seed), F.col("id")), size) + 1).alias("_rank"),
            (F.col("id") - first + 1).alias("draw"),
            F.pmod(F.xxhash64("id"), salt).cast("int").alias("_salt"),
        )
        ranked = digest_rank(df.where(F.col(label).isin(list(extra))), [label], key, seed, "_rank")
        # a row that very many draws name is repeated, and each copy serves a share of them
        ranked = ranked.withColumn("_salt", F.explode(F.sequence(F.lit(0), (wide - 1).cast("int"))))
        original = original.unionByName(ranked.join(draws, [label, "_rank", "_salt"]).drop("_rank", "_salt"))
    return original.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col(key), F.col("draw")))


def permute_within(df: DataFrame, key: str, columns: list[str], seed: int = 42) -> DataFrame:
    """Give every row the ``columns`` of another: row i in key order takes those of row i in digest order."""
    fixed = dense_index(df.drop(*columns), key, "_position")
    moved = digest_rank(df.select(key, *columns), [], key, seed, "_rank").select(
        (F.col("_rank") - 1).alias("_position"), *columns
    )
    return fixed.join(moved, "_position").select(*df.columns)
