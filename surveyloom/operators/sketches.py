"""Column profiles that merge: one row of counts, moments and sketches per column, stored with a version.

The profile of a table that grew is the stored profile of what was there merged with that of the new rows: old rows are not read again. Distinct values come
from HyperLogLog sketches (relative standard error 1.04 / sqrt(2 ** precision)), quantiles from KLL sketches (the rank is off by about 2.3 / size ** 0.9 of the rows); both
have a size that does not grow with the rows, and the counts, means, deviations and extremes are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.functions.numbers import number, rounded

#: Base-2 logarithm of a distinct sketch's registers, and the size parameter of a quantile sketch.
PRECISION, SIZE = 14, 800


def sketch_columns(df: DataFrame, columns: list[str], precision: int = PRECISION, size: int = SIZE) -> DataFrame:
    """One row per column: rows, nulls, numbers with mean and squared deviations, extremes, and the two sketches.

    One pass and one shuffle of partial states. Texts that are no numbers count for the distinct values only; NaN is no number. A table without rows gives no row.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), number(df, c).alias("num")) for c in columns]
    )
    return df.select(F.inline(cells)).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.count("num").alias("count"),
        F.avg("num").alias("mean"),
        (F.var_pop("num") * F.count("num")).alias("squares"),
        F.min("num").alias("min"),
        F.max("num").alias("max"),
        F.hll_sketch_agg("value", precision).alias("distinct"),
        F.kll_sketch_agg_double("num", F.lit(size)).alias("ranks"),
    )


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """The sketches of all parts together, in the same form; parts may be merged in any order and again."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    own = Window.partitionBy("column")
    middle = F.sum(F.col("mean") * F.col("count")).over(own) / F.sum("count").over(own)
    # squared deviations move to the common mean, so nothing large cancels
    off = F.coalesce(F.col("squares"), F.lit(0.0)) + F.coalesce(F.col("count") * (F.col("mean") - F.col("_middle")) ** 2, F.lit(0.0))
    moved = every.withColumn("_middle", F.when(F.sum("count").over(own) > 0, middle))
    return moved.withColumn("_squares", F.when(F.col("_middle").isNotNull(), off)).groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_null").alias("n_null"),
        F.sum("count").alias("count"),
        F.max("_middle").alias("mean"),
        F.sum("_squares").alias("squares"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("ranks").alias("ranks"),
    )


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """column, n_rows, n_null, n_unique (estimate), count, mean, std, min, quartiles (estimates), max. Columns without a number have nulls from ``mean`` on."""

    def quantile(p: float) -> Column:
        return F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(p)))

    std = F.when(F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1))).when(F.col("count") == 1, F.lit(0.0))
    return sketches.select(
        "column",
        "n_rows",
        "n_null",
        F.hll_sketch_estimate("distinct").alias("n_unique"),
        "count",
        rounded(F.col("mean")).alias("mean"),
        rounded(std).alias("std"),
        "min",
        quantile(0.25).alias("q25"),
        quantile(0.5).alias("median"),
        quantile(0.75).alias("q75"),
        "max",
    )


def store_sketches(sketches: DataFrame, path: str) -> DataFrame:
    """Write a version's sketches (one row per column) and read them back."""
    sketches.coalesce(1).write.parquet(path)
    return sketches.sparkSession.read.schema(sketches.schema).parquet(path)


def grown_profile(spark: SparkSession, earlier: str, added: DataFrame, columns: list[str], path: str) -> DataFrame:
    """Sketches of a table that ``added`` rows were appended to: those stored at ``earlier`` merged with the added rows'. Stored at ``path``."""
    return store_sketches(merge_sketches(spark.read.parquet(earlier), sketch_columns(added, columns)), path)
