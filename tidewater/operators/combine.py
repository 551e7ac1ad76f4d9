"""Weights, orthogonalisation and combination of factors.

Moments of all rows are aggregated in Spark; what reaches the driver is a few numbers per pair of factors,
on which the small linear algebra is done.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.stats import both, safe_corr
from tidewater.operators.factors import aligned, group_returns, ic_by_date, ic_by_factor, ic_summary, monotonicity

MIN_POINTS = 10

Weights = dict[str, float]


def _normal(raw: Weights) -> Weights:
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total > 0 else equal(list(raw))


def present(panel: DataFrame, names: list[str]) -> list[str]:
    """The factors that have a value in the panel at all."""
    got = panel.agg(*(F.count(n).alias(n) for n in names)).first()
    return [n for n in names if got[n]]


def equal_of(panel: DataFrame, names: list[str]) -> Weights:
    """Equal weights of the factors that the panel holds, 0 for the others; equal ones of all where it holds none."""
    held = present(panel, names) or names
    return {n: 1.0 / len(held) if n in held else 0.0 for n in names}


def equal(names: list[str]) -> Weights:
    return {n: 1.0 / len(names) for n in names}


def _ics(panel: DataFrame, names: list[str], ret: str, k: int) -> dict[str, tuple[float, float]]:
    """Mean and ratio of each factor's correlations with the return."""
    got = {r["factor"]: r for r in ic_by_factor(panel, names, ret, k).collect()}  # a row for each factor
    return {n: (got[n]["ic_mean"] or 0.0, got[n]["ic_ir"] or 0.0) if n in got else (0.0, 0.0) for n in names}


def ic_weights(panel: DataFrame, names: list[str], ret: str, k: int = 1) -> Weights:
    """By the size of the mean correlation; equal if all are zero."""
    return _normal({n: abs(m) for n, (m, _) in _ics(panel, names, ret, k).items()})


def ir_weights(panel: DataFrame, names: list[str], ret: str, k: int = 1) -> Weights:
    """By the size of the correlation's mean over its deviation."""
    return _normal({n: abs(r) for n, (_, r) in _ics(panel, names, ret, k).items()})


def max_diversification(names: list[str]) -> Weights:
    """Equal weights: the reference semantics of this method."""
    return equal(names)


def covariance(panel: DataFrame, names: list[str]) -> np.ndarray:
    """Pooled sample covariances over rows where both factors are known; 0 (1 on the diagonal) for under ten of those."""
    cells = []
    for i, a in enumerate(names):
        for b in names[i:]:
            x, y = both(a, b)
            cells.append(F.struct(F.covar_samp(x, y).alias("c"), F.count(x).alias("n")))
    got = panel.agg(F.array(*cells).alias("m")).first()["m"]
    out, it = np.zeros((len(names), len(names))), iter(got)
    for i in range(len(names)):
        for j in range(i, len(names)):
            c = next(it)
            out[i, j] = out[j, i] = (c["c"] if c["n"] >= MIN_POINTS and c["c"] is not None else float(i == j))
    return out


def _solved(cov: np.ndarray, by: np.ndarray, names: list[str]) -> Weights | None:
    try:
        w = np.clip(np.linalg.solve(cov, by), 0, None)
    except np.linalg.LinAlgError:
        return None
    return _normal(dict(zip(names, w.tolist())))


def min_variance(panel: DataFrame, names: list[str]) -> Weights:
    """Solution of the covariance against ones, without negative weights; equal if it is singular."""
    return _solved(covariance(panel, names), np.ones(len(names)), names) or equal(names)


def max_sharpe(panel: DataFrame, names: list[str], ret: str | None = None, k: int = 1) -> Weights:
    """Solution against absolute mean correlations; these themselves if the covariance is singular, and minimum variance without returns."""
    if ret is None:
        return min_variance(panel, names)
    ics = _ics(panel, names, ret, k)
    return _solved(covariance(panel, names), np.array([abs(ics[n][0]) for n in names]), names) or ic_weights(panel, names, ret, k)


def risk_parity(panel: DataFrame, names: list[str]) -> Weights:
    """Inverse population deviation; one for factors of ten values or fewer, or none."""
    r = panel.agg(*(F.stddev_pop(n).alias(n) for n in names), *(F.count(n).alias(f"_n{i}") for i, n in enumerate(names))).first()
    dev = {n: r[n] if r[f"_n{i}"] > MIN_POINTS and r[n] else 1.0 for i, n in enumerate(names)}
    return _normal({n: 1.0 / d for n, d in dev.items()})


def complete(panel: DataFrame, names: list[str]) -> DataFrame:
    d = panel
    for n in names:
        d = d.where(F.col(n).isNotNull())
    return d


def _standard(panel: DataFrame, names: list[str]) -> tuple[dict[str, tuple[float, float]], np.ndarray, int]:
    """Means and population deviations over complete rows, their correlation matrix, and their number."""
    d = complete(panel, names)
    pairs = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]
    r = d.agg(F.array(*(F.avg(n) for n in names)).alias("m"), F.array(*pairs).alias("c"), F.count("*").alias("n")).first()
    if not r["n"]:
        return {n: (0.0, 1.0) for n in names}, np.eye(len(names)), 0
    cov, it = np.zeros((len(names), len(names))), iter(r["c"])
    for i in range(len(names)):
        for j in range(i, len(names)):
            cov[i, j] = cov[j, i] = next(it)
    dev = np.sqrt(np.diag(cov))
    dev[dev == 0] = 1.0
    return {n: (float(m), float(s)) for n, m, s in zip(names, r["m"], dev)}, cov / np.outer(dev, dev), r["n"]


def _axes(corr: np.ndarray) -> np.ndarray:
    """Eigenvectors by falling eigenvalue, each with its largest component positive."""
    w, u = np.linalg.eigh(corr)
    u = u[:, np.argsort(-w, kind="stable")]
    return u * np.where(u[np.abs(u).argmax(axis=0), np.arange(len(u))] < 0, -1.0, 1.0)


def pca_weights(panel: DataFrame, names: list[str]) -> Weights:
    """Absolute loadings of the first component."""
    _, corr, n = _standard(panel, names)
    return _normal(dict(zip(names, np.abs(_axes(corr)[:, 0]).tolist()))) if n else equal(names)


def residual(panel: DataFrame, factor: str, reference: str, out: str | None = None) -> DataFrame:
    """What is left of a factor after its pooled regression on a reference; null where either is; unchanged under ten rows of both."""
    y, x = both(factor, reference)
    line = panel.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.count(x).alias("_n"))
    d = panel.crossJoin(F.broadcast(line))  # one row
    rest = F.when(F.col("_n") < MIN_POINTS, F.col(factor)).otherwise(F.col(factor) - (F.col("_a") + F.col("_b") * F.col(reference)))
    return d.withColumn(out or factor, rest).drop("_a", "_b", "_n")


def pca(panel: DataFrame, names: list[str]) -> DataFrame:
    """Factors replaced by their component scores on complete rows; unchanged under ten complete rows a factor."""
    facts, corr, n = _standard(panel, names)
    if n < MIN_POINTS * len(names):
        return panel
    u = _axes(corr)
    z = [(F.col(k) - facts[k][0]) / facts[k][1] for k in names]
    full = F.lit(True)
    for k in names:
        full &= F.col(k).isNotNull()
    return panel.withColumns({k: F.when(full, sum((float(u[i, j]) * z[i] for i in range(len(names))), F.lit(0.0))) for j, k in enumerate(names)})


def gram_schmidt(panel: DataFrame, names: list[str], tiny: float = 1e-10) -> DataFrame:
    """Factors made orthogonal one after the other over complete rows, each of unit norm; norms up to ``tiny`` are left as they are.

    The dot products of all rows give the coefficients, so every new factor is one linear expression.
    """
    d = complete(panel, names)
    pairs = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    got = iter(d.agg(F.array(*pairs).alias("c")).first()["c"])
    g = np.zeros((len(names), len(names)))
    for i in range(len(names)):
        for j in range(i, len(names)):
            g[i, j] = g[j, i] = next(got) or 0.0
    basis: list[np.ndarray] = []
    for i in range(len(names)):
        v = np.eye(len(names))[i]
        for b in basis:
            bb = b @ g @ b
            if bb > 0:
                v = v - (v @ g @ b) / bb * b
        norm = float(np.sqrt(max(0.0, v @ g @ v)))
        basis.append(v / norm if norm > tiny else v)
    full = F.lit(True)
    for k in names:
        full &= F.col(k).isNotNull()
    return panel.withColumns({k: F.when(full, sum((float(c) * F.col(n) for c, n in zip(basis[i], names)), F.lit(0.0))) for i, k in enumerate(names)})


def orthogonalize(panel: DataFrame, names: list[str], method: str = "none", reference: str | None = None) -> DataFrame:
    if method == "none":
        return panel
    if method == "residual":
        ref = reference or names[0]
        for n in names:
            if n != ref:
                panel = residual(panel, n, ref)
        return panel
    if method == "pca":
        return pca(panel, names)
    if method == "gram_schmidt":
        return gram_schmidt(panel, names)
    raise ValueError(f"unknown method {method!r}")


def weights(panel: DataFrame, names: list[str], method: str, ret: str | None = None, k: int = 1) -> Weights:
    if method in ("ic_weight", "ir_weight") and ret is None:
        return equal(names)
    make = {
        "equal_weight": lambda: equal_of(panel, names), "ic_weight": lambda: ic_weights(panel, names, ret, k), "ir_weight": lambda: ir_weights(panel, names, ret, k),
        "max_diversification": lambda: equal_of(panel, names), "min_variance": lambda: min_variance(panel, names), "max_sharpe": lambda: max_sharpe(panel, names, ret, k),
        "risk_parity": lambda: risk_parity(panel, names), "pca": lambda: pca_weights(panel, names),
    }
    if method not in make:
        raise ValueError(f"unknown method {method!r}")
    return make[method]()


def combine(panel: DataFrame, w: Weights, out: str = "combined") -> DataFrame:
    """Weighted sum; null if any factor of weight other than zero is."""
    return panel.withColumn(out, sum((F.lit(float(v)) * F.col(n) for n, v in w.items() if v), F.lit(0.0)))


def concentration(w: Weights) -> dict[str, float]:
    """Effective number of factors and Herfindahl index."""
    h = sum(v * v for v in w.values() if v > 0)
    return {"effective_number": 1 / h if h else 0.0, "herfindahl": sum(v * v for v in w.values())}


def metrics(panel: DataFrame, w: Weights, ret: str, k: int = 1, q: int = 10) -> DataFrame:
    """One row on a combination: how concentrated its weights are, and its rank correlation, spread and monotonicity against returns."""
    d = combine(panel, w, "_combined")
    spread = monotonicity(group_returns(d, "_combined", ret, q, k))
    ic = ic_summary(ic_by_date(aligned(d, "_combined", ret, k), "_combined", ret)).select(F.col("ic_mean").alias("ic"), F.col("ic_ir").alias("ir"))
    facts = concentration(w)
    return ic.crossJoin(F.broadcast(spread)).select(*(F.lit(float(v)).alias(n) for n, v in facts.items()), "ic", "ir", "spread", "monotonicity")  # one row each


def correlations(panel: DataFrame, names: list[str]) -> DataFrame:
    """Pooled correlation of each pair of factors over rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(a, b).alias("correlation")) for a, b in pairs))
    return panel.agg(cells.alias("c")).select(F.explode("c").alias("c")).select("c.*")


def weight_rows(panel: DataFrame, w: Weights) -> DataFrame:
    return panel.sparkSession.createDataFrame([(n, float(v)) for n, v in w.items()], "factor string, weight double")
