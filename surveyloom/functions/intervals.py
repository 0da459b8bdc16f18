"""Confidence intervals as closed-form columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.functions.numbers import rounded

# Two-sided 95 % critical values of the normal and of Student's t for 1..30 degrees of freedom.
Z_95 = 1.959963984540054
T_95 = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.16, 2.145, 2.131, 2.12, 2.11, 2.101, 2.093, 2.086,
    2.08, 2.074, 2.069, 2.064, 2.06, 2.056, 2.052, 2.048, 2.045, 2.042,
]


def _only_95(confidence: float) -> None:
    if abs(confidence - 0.95) > 1e-9:
        raise ValueError("only the 0.95 level has critical values")


def t_critical(df: Column, confidence: float = 0.95) -> Column:
    """Table lookup for 1..30 degrees of freedom, the normal value beyond."""
    _only_95(confidence)
    table = F.array(*[F.lit(v) for v in T_95])
    return F.when(df.between(1, len(T_95)), F.get(table, (df - 1).cast("int"))).otherwise(F.lit(Z_95))


def wilson_bounds(successes: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """(low, high) of the Wilson score interval, unrounded; zeros for an empty total."""
    _only_95(confidence)
    n = total.cast("double")
    p = successes.cast("double") / F.when(n > 0, n)
    z2 = Z_95 * Z_95
    denominator = 1.0 + z2 / n
    centre = (p + z2 / (2.0 * n)) / denominator
    margin = Z_95 * F.sqrt((p * (1.0 - p) + z2 / (4.0 * n)) / n) / denominator
    low = F.when(total > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0)
    high = F.when(total > 0, F.least(F.lit(1.0), centre + margin)).otherwise(0.0)
    return low, high


def wilson(successes: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    low, high = wilson_bounds(successes, total, confidence)
    return rounded(low), rounded(high)


def t_bounds(mean: Column, std: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """(low, high) of the t interval of a mean; degenerate for n = 1 or no spread, zeros for n = 0."""
    margin = t_critical(n - 1, confidence) * (std / F.sqrt(n.cast("double")))
    spread = F.when((n > 1) & (std > 0), margin).otherwise(0.0)
    low = F.when(n > 0, mean - spread).otherwise(0.0)
    high = F.when(n > 0, mean + spread).otherwise(0.0)
    return rounded(low), rounded(high)
