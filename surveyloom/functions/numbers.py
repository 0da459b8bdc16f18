"""Numeric coercion, rounding and small helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


#: Doubles of this size and more are whole numbers.
WHOLE_FROM = float(1 << 52)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a finite-or-infinite number becomes null (NaN included)."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def number(df: DataFrame, name: str) -> Column:
    """A column as a number: text is parsed, numeric types are only widened."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    return not_nan(c.cast("double")) if isinstance(kind, NumericType) else to_number(c)


def not_nan(c: Column) -> Column:
    """NaN sorts above every number in Spark; treat it as missing instead."""
    return F.when(~F.isnan(c), c)


def rounded(c: Column, digits: int = 4) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: one rule that every engine evaluates alike, and cheaper than a decimal detour.

    What lies within a millionth of a half counts as a half, so the order of a sum does not decide a tie. From 2^52 on the scaled number
    has no fraction left, and its floor would leave the 64 bits of an integer: such values, infinities and NaN stay as they are.
    """
    scale = F.lit(float(10**digits))
    value = c.cast("double")
    scaled = value * scale
    return F.when(F.abs(scaled) >= F.lit(WHOLE_FROM), value).otherwise(F.floor(scaled + F.lit(0.500001)) / scale)


#: Characters from which a level is grouped by its digest.
LONG_LEVEL = 64


def level_key(c: Column) -> Column:
    """What a text is grouped by where only equality counts: itself while it is short, else its SHA-256, so whole texts are not shuffled."""
    text = c.cast("string")
    return F.when(F.length(text) > LONG_LEVEL, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def blank_to_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clip(c: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; null stays null (greatest/least would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den as double, ``default`` when the denominator is zero or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))


def uniform_from_hash(*cols: Column) -> Column:
    """A double in [0, 1) fixed by the values of ``cols``: the same on every run, cluster and partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def softmax(logits: Column) -> Column:
    """Softmax of array<double> with the maximum taken out first."""
    peak = F.array_max(logits)
    powers = F.transform(logits, lambda v: F.exp(v - peak))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(powers, lambda v: v / total)
