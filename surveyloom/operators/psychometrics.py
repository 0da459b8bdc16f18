"""Scale reliability, factor models and factor scores.

One distributed pass yields the count, means and 9 x 9 covariance of the complete rows. Fitting works on that fixed-size
matrix; scoring is a projection of the rows with literal weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numbers import clip
from surveyloom.operators.association import spearman_matrix
from surveyloom.operators.common import sum_columns
from surveyloom.session import settle
from surveyloom.sources.tables import FACTORS

LOADING_SCHEMA = "item string, factor string, loading double"


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray  # divided by n

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    @property
    def corr(self) -> np.ndarray:
        return self.cov / np.outer(self.std, self.std)


def moments(df: DataFrame, items: list[str]) -> Moments:
    """Count, means and covariances over rows with every item present: one aggregate, one row to the driver."""
    rows = df.select(*[F.col(i).cast("double").alias(i) for i in items]).dropna()
    pairs = [(a, b) for a in range(len(items)) for b in range(a, len(items))]
    row = rows.agg(
        F.count(F.lit(1)),
        *[F.avg(i) for i in items],
        *[F.covar_pop(items[a], items[b]) for a, b in pairs],
    ).first()
    n, p = int(row[0]), len(items)
    if n == 0:
        raise ValueError("no row has every item")
    cov = np.zeros((p, p))
    for (a, b), value in zip(pairs, row[1 + p :], strict=True):
        cov[a, b] = cov[b, a] = value
    return Moments(n, np.array(row[1 : 1 + p], dtype=float), cov)


def _alpha(items: list[str]) -> tuple[Column, Column]:
    """(alpha, rows) of one set of items over its own complete rows; null with fewer than two items or no variance."""
    present = F.lit(True)
    for i in items:
        present = present & F.col(i).isNotNull()
    values = [F.when(present, F.col(i).cast("double")) for i in items]
    k = len(items)
    parts = sum_columns([F.var_samp(v) for v in values])
    total = F.var_samp(sum_columns(values))
    alpha = F.when(total > 0, (k / (k - 1)) * (1.0 - parts / total)) if k > 1 else F.lit(None).cast("double")
    return clip(alpha, -1.0, 1.0), F.count_if(present)


def cronbach_alpha(df: DataFrame, factors: dict[str, list[str]] = FACTORS) -> DataFrame:
    """Alpha of every factor, and with each item left out, all sets in one pass. ``dropped`` is empty for the full set."""
    sets = [(f, "", items) for f, items in factors.items()]
    sets += [(f, out, [i for i in items if i != out]) for f, items in factors.items() for out in items]
    aggs = []
    for j, (_, _, items) in enumerate(sets):
        alpha, n = _alpha(items)
        aggs += [alpha.alias(f"a{j}"), n.alias(f"n{j}")]
    rows = [
        F.struct(F.lit(f).alias("factor"), F.lit(out).alias("dropped"), F.col(f"a{j}").alias("alpha"), F.col(f"n{j}").alias("n"))
        for j, (f, out, _) in enumerate(sets)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def mcdonald_omega(loadings: DataFrame, factors: dict[str, list[str]] | None = None) -> DataFrame:
    """Omega per factor from (item, factor, loading) rows: all rows of a factor, or its own items when they are given."""
    rows = loadings.where(F.col("loading").isNotNull())
    if factors is not None:
        own = F.lit(False)
        for factor, items in factors.items():
            own = own | ((F.col("factor") == factor) & F.col("item").isin(items))
        rows = rows.where(own)
    sums = rows.groupBy("factor").agg(
        F.sum("loading").alias("s"), F.sum(1.0 - F.col("loading") * F.col("loading")).alias("u")
    )
    denominator = F.col("s") * F.col("s") + F.col("u")
    omega = F.when(denominator != 0, F.col("s") * F.col("s") / denominator)
    return sums.select("factor", clip(omega, 0.0, 1.0).alias("omega"))


def reliability_report(df: DataFrame, loadings: DataFrame, factors: dict[str, list[str]] = FACTORS) -> DataFrame:
    """(factor, metric, item, value): alpha, alpha without each item, and omega."""
    alpha = cronbach_alpha(df, factors).select(
        "factor",
        F.when(F.col("dropped") == "", "alpha").otherwise("alpha_if_deleted").alias("metric"),
        F.col("dropped").alias("item"),
        F.col("alpha").alias("value"),
    )
    omega = mcdonald_omega(loadings).select(
        "factor", F.lit("omega").alias("metric"), F.lit("").alias("item"), F.col("omega").alias("value")
    )
    return alpha.unionByName(omega)


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square by the two-step recurrence in the degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    tail, k = (math.exp(-half), 2) if df % 2 == 0 else (math.erfc(math.sqrt(half)), 1)
    while k < df:
        tail += math.exp(k / 2.0 * math.log(half) - half - math.lgamma(k / 2.0 + 1.0))
        k += 2
    return min(1.0, tail)


@dataclass
class FactorModel:
    items: list[str]
    factors: list[str]
    loadings: np.ndarray  # items x factors
    weights: np.ndarray  # items x factors: standardised items to scores
    moments: Moments
    method: str
    fit: dict[str, float]
    score_se: float

    def loading_rows(self, spark) -> DataFrame:
        rows = [(i, f, float(self.loadings[a, b])) for a, i in enumerate(self.items) for b, f in enumerate(self.factors)]
        return spark.createDataFrame(rows, LOADING_SCHEMA)


def confirmatory_fit(m: Moments, factors: dict[str, list[str]], max_iter: int = 200) -> tuple[np.ndarray, dict[str, float]]:
    """Maximum-likelihood simple-structure model: first loading of each factor 1, factors correlated.

    Fisher scoring with step halving on ln|Sigma| + tr(S Sigma^-1) - ln|S| - p. A fit that has not converged within ``max_iter`` steps is an error.
    """
    items = [i for group in factors.values() for i in group]
    p, k = len(items), len(factors)
    s = m.cov
    sign, logdet_s = np.linalg.slogdet(s)
    if sign <= 0:
        raise ValueError("the covariance matrix is singular")
    owner = [f for f, group in enumerate(factors.values()) for _ in group]
    first = {f: owner.index(f) for f in range(k)}
    free = [i for i in range(p) if i != first[owner[i]]]
    phi_pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def unpack(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        loading = np.zeros((p, k))
        for f, i in first.items():
            loading[i, f] = 1.0
        for value, i in zip(theta, free, strict=False):
            loading[i, owner[i]] = value
        phi = np.zeros((k, k))
        for value, (a, b) in zip(theta[len(free) :], phi_pairs, strict=False):
            phi[a, b] = phi[b, a] = value
        return loading, phi, theta[len(free) + len(phi_pairs) :]

    def discrepancy(theta: np.ndarray) -> float:
        loading, phi, psi = unpack(theta)
        sigma = loading @ phi @ loading.T + np.diag(psi)
        sign, logdet = np.linalg.slogdet(sigma)
        if sign <= 0 or np.any(psi <= 0):
            return math.inf
        return float(logdet + np.trace(np.linalg.solve(sigma, s)) - logdet_s - p)

    def slopes(theta: np.ndarray) -> list[np.ndarray]:
        loading, phi, _ = unpack(theta)
        out = []
        for i in free:
            unit = np.zeros((p, k))
            unit[i, owner[i]] = 1.0
            half = unit @ phi @ loading.T
            out.append(half + half.T)
        for a, b in phi_pairs:
            unit = np.zeros((k, k))
            unit[a, b] = unit[b, a] = 1.0
            out.append(loading @ unit @ loading.T)
        for i in range(p):
            unit = np.zeros((p, p))
            unit[i, i] = 1.0
            out.append(unit)
        return out

    variances = np.diag(s)
    start = [1.0] * len(free)
    start += [variances[first[a]] * 0.5 if a == b else 0.0 for a, b in phi_pairs]
    theta = np.array(start + list(variances * 0.5))
    value, converged = discrepancy(theta), False
    for _ in range(max_iter):
        loading, phi, psi = unpack(theta)
        inverse = np.linalg.inv(loading @ phi @ loading.T + np.diag(psi))
        excess = inverse - inverse @ s @ inverse
        d = [inverse @ x for x in slopes(theta)]
        gradient = np.array([np.sum(excess * x) for x in slopes(theta)])
        information = np.array([[np.sum(x * y.T) for y in d] for x in d])
        step = np.linalg.lstsq(information, gradient, rcond=None)[0]
        size = 1.0
        while size > 1e-8 and not discrepancy(theta - size * step) < value:
            size /= 2.0
        if size <= 1e-8:  # no shorter step helps: an optimum if the full one promised nothing
            converged = float(gradient @ step) < 1e-8
            break
        theta = theta - size * step
        new = discrepancy(theta)
        converged = value - new < 1e-12
        value = new
        if converged:
            break
    if not (converged and math.isfinite(value)):
        raise ValueError("the factor model did not converge")
    loading, _, _ = unpack(theta)
    return loading, fit_indices(value, m, p, len(theta))


def fit_indices(discrepancy: float, m: Moments, p: int, n_free: int) -> dict[str, float]:
    """Chi-square of the model against the independence model, and the indices built on the two."""
    chi2 = max(0.0, m.n * discrepancy)
    df = p * (p + 1) // 2 - n_free
    base = m.n * float(np.sum(np.log(np.diag(m.cov))) - np.linalg.slogdet(m.cov)[1])
    base_df = p * (p - 1) // 2
    worse = max(base - base_df, chi2 - df, 0.0)
    gfi = 1.0 - chi2 / base if base > 0 else 1.0
    return {
        "chi2": chi2,
        "chi2_df": float(df),
        "chi2_p": chi2_tail(chi2, df),
        "cfi": 1.0 - max(chi2 - df, 0.0) / worse if worse > 0 else 1.0,
        "tli": (base / base_df - chi2 / df) / (base / base_df - 1.0),
        "nfi": (base - chi2) / base if base > 0 else 1.0,
        "gfi": gfi,
        "agfi": 1.0 - base_df / df * (1.0 - gfi),
        "rmsea": math.sqrt(max(chi2 / df - 1.0, 0.0) / max(m.n - 1, 1)),
    }


def _varimax(a: np.ndarray, max_iter: int = 500) -> tuple[np.ndarray, bool]:
    """Varimax rotation of loadings with rows scaled to length one, and whether it converged.

    Each plane of two factors is turned by its best angle, which has a closed form, until no plane turns any more.
    """
    h = np.sqrt(np.sum(a * a, axis=1, keepdims=True))
    z = a / h
    planes = [(i, j) for i in range(a.shape[1]) for j in range(i + 1, a.shape[1])]
    for _ in range(max_iter):
        largest = 0.0
        for i, j in planes:
            u, v = z[:, i] ** 2 - z[:, j] ** 2, 2.0 * z[:, i] * z[:, j]
            up = 2.0 * (u @ v - u.sum() * v.sum() / len(z))
            along = u @ u - v @ v - (u.sum() ** 2 - v.sum() ** 2) / len(z)
            angle = float(np.arctan2(up, along)) / 4.0 if math.hypot(up, along) > 1e-14 else 0.0
            turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
            z[:, [i, j]] = z[:, [i, j]] @ turn
            largest = max(largest, abs(angle))
        if largest < 1e-9:
            return z * h, True
    return z * h, False


def exploratory_fit(m: Moments, k: int, power: int = 4, max_iter: int = 5000) -> tuple[np.ndarray, np.ndarray, dict[str, object]]:
    """Minimum-residual factors of the correlation matrix with promax rotation: (loadings, score weights, summary). ``converged`` holds for both iterations."""
    r = m.corr
    shared = 1.0 - 1.0 / np.diag(np.linalg.inv(r))
    settled = False
    for _ in range(max_iter):
        reduced = r.copy()
        np.fill_diagonal(reduced, shared)
        values, vectors = np.linalg.eigh(reduced)
        top = np.argsort(values)[::-1][:k]
        a = vectors[:, top] * np.sqrt(np.maximum(values[top], 0.0))
        new = np.minimum(np.sum(a * a, axis=1), 0.995)
        settled = bool(np.max(np.abs(new - shared)) < 1e-10)
        shared = new
        if settled:
            break
    a = a * np.where(a.sum(axis=0) < 0, -1.0, 1.0)
    x, turned = _varimax(a)
    target = x * np.abs(x) ** (power - 1)
    u = np.linalg.lstsq(x, target, rcond=None)[0]
    u = u @ np.diag(np.sqrt(np.diag(np.linalg.inv(u.T @ u))))
    loadings = x @ u
    phi = np.linalg.inv(u.T @ u)
    weights = np.linalg.solve(r, loadings @ phi)
    summary = {
        "eigenvalues": sorted(np.linalg.eigvalsh(r).tolist(), reverse=True),
        "communalities": shared.tolist(),
        "variance_explained": (np.sum(loadings * loadings, axis=0) / len(r)).tolist(),
        "converged": settled and turned,
    }
    return loadings, weights, summary


def align_factors(loadings: DataFrame, factors: dict[str, list[str]] = FACTORS) -> DataFrame:
    """(target, source): for each intended factor in turn, the unused source with the largest mean absolute loading."""
    intended = F.create_map(*[F.lit(x) for f, items in factors.items() for i in items for x in (i, f)])
    means = (
        loadings.withColumn("target", F.try_element_at(intended, F.col("item")))
        .where(F.col("target").isNotNull())
        .groupBy("target", F.col("factor").alias("source"))
        .agg(F.avg(F.abs("loading")).alias("mean_abs"))
    )
    order, chosen = list(factors), []
    table = sorted(means.collect(), key=lambda r: (order.index(r["target"]), -r["mean_abs"], r["source"]))
    for target in order:
        free = [r for r in table if r["target"] == target and r["source"] not in [c[1] for c in chosen]]
        if free:
            chosen.append((target, free[0]["source"], float(free[0]["mean_abs"])))
    return loadings.sparkSession.createDataFrame(chosen, "target string, source string, mean_abs double")


def projection_weights(loadings: np.ndarray) -> np.ndarray:
    return loadings @ np.linalg.pinv(loadings.T @ loadings)


def score_error(m: Moments, loadings: np.ndarray) -> float:
    """Standard deviation of what the scores leave of the standardised items, from the moments alone."""
    scale = m.std + 1e-8
    c = m.cov / np.outer(scale, scale)
    left = np.eye(len(scale)) - projection_weights(loadings) @ loadings.T
    return float(math.sqrt(max(0.0, np.trace(left.T @ c @ left) / len(scale))))


def score_rows(df: DataFrame, key: str, items: list[str], factors: list[str], m: Moments, weights: np.ndarray) -> DataFrame:
    """Factor scores of every complete row: plain arithmetic inside the scan's stage."""
    scale = m.std + 1e-8
    z = [(F.col(i).cast("double") - float(m.mean[a])) / float(scale[a]) for a, i in enumerate(items)]
    columns = [
        sum_columns([z[a] * float(weights[a, b]) for a in range(len(items)) if weights[a, b] != 0.0] or [F.lit(0.0)]).alias(f)
        for b, f in enumerate(factors)
    ]
    return df.dropna(subset=items).select(key, *columns)


def score_with_loadings(df: DataFrame, key: str, items: list[str], factors: list[str], loadings: np.ndarray) -> DataFrame:
    return score_rows(df, key, items, factors, moments(df, items), projection_weights(loadings))


def fit_factor_model(df: DataFrame, factors: dict[str, list[str]] = FACTORS) -> FactorModel:
    """Confirmatory model; if that fails, exploratory factors matched to the intended ones."""
    items, names = [i for g in factors.values() for i in g], list(factors)
    missing = [i for i in items if i not in df.columns]
    if missing:
        raise ValueError(f"missing item columns: {missing}")
    m = moments(df, items)
    try:
        loadings, fit = confirmatory_fit(m, factors)
        return FactorModel(
            items, names, loadings, projection_weights(loadings), m, "confirmatory", fit, score_error(m, loadings)
        )
    except (ValueError, np.linalg.LinAlgError):
        loadings, weights, fit = exploratory_fit(m, len(names))
        table = df.sparkSession.createDataFrame(
            [(i, str(b), float(loadings[a, b])) for a, i in enumerate(items) for b in range(len(names))], LOADING_SCHEMA
        )
        order = [int(r["source"]) for r in align_factors(table, factors).collect()]
        return FactorModel(items, names, loadings[:, order], weights[:, order], m, "exploratory", fit, 0.1)


def psychometrics_report(df: DataFrame, key: str = "survey_id", factors: dict[str, list[str]] = FACTORS) -> dict[str, DataFrame]:
    """Scores, loadings, fit, reliability and item correlations as frames; scores are written once and shared."""
    model = fit_factor_model(df, factors)
    spark = df.sparkSession
    loadings = model.loading_rows(spark)
    fit = [(k, float(v)) for k, v in model.fit.items() if isinstance(v, float)]
    fit += [("n_obs", float(model.moments.n)), ("score_se", model.score_se)]
    return {
        "scores": settle(score_rows(df, key, model.items, model.factors, model.moments, model.weights), "scores"),
        "loadings": loadings,
        "fit": spark.createDataFrame([(model.method, k, v) for k, v in fit], "method string, metric string, value double"),
        "reliability": reliability_report(df, loadings, factors),
        "correlations": spearman_matrix(df, model.items),
    }
