"""One regression an attribute: cells (``obs``, ``attr``, ``v``) on metadata columns of observations.

Each attribute is one group of a grouped map; p-values are adjusted by window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import norm_sf2, t_sf2
from .stats import p_adjust

RESULT = "term string, coef double, std_err double, statistic double, p_value double, ci_low double, ci_high double, nobs long, loglik double, r2 double, converged boolean"


def design(frame: pd.DataFrame, variables: list[str], levels: dict[str, list]) -> tuple[list[str], np.ndarray]:
    """Intercept, numeric variables and treatment-coded levels (against the first)."""
    names, cols = ["Intercept"], [np.ones(len(frame))]
    for v in variables:
        if v in levels:
            for level in levels[v][1:]:
                names.append(f"{v}[T.{level}]")
                cols.append((frame[v] == level).to_numpy(float))
        else:
            names.append(v)
            cols.append(frame[v].to_numpy(float))
    return names, np.column_stack(cols)


def _t_quantile(df: float) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf2(mid, df) > 0.05 else (lo, mid)
    return lo


def irls(x: np.ndarray, y: np.ndarray, family: str = "gaussian", steps: int = 100):
    """Coefficients, covariance, log-likelihood, fitted means and whether it converged, by iterated least squares with canonical links."""
    n, k = x.shape
    mu = {"gaussian": y, "poisson": np.maximum(y, 0.5), "binomial": (y + 0.5) / 2, "gamma": np.maximum(y, 1e-8)}[family].astype(float)
    link = {"gaussian": lambda m: m, "poisson": np.log, "binomial": lambda m: np.log(m / (1 - m)), "gamma": lambda m: 1 / m}[family]
    back = {"gaussian": lambda e: e, "poisson": lambda e: np.exp(np.clip(e, -700, 700)), "binomial": lambda e: 1 / (1 + np.exp(-np.clip(e, -700, 700))), "gamma": lambda e: 1 / np.where(np.abs(e) < 1e-12, 1e-12, e)}[family]
    var = {"gaussian": np.ones_like, "poisson": lambda m: m, "binomial": lambda m: m * (1 - m), "gamma": lambda m: m * m}[family]
    eta, beta, ok = link(mu), np.zeros(k), False
    for _ in range(steps):
        w = np.maximum(var(mu), 1e-10)
        slope = {"gaussian": 1.0, "poisson": 1 / mu, "binomial": 1 / np.maximum(mu * (1 - mu), 1e-10), "gamma": -1 / mu**2}[family]
        z = eta + (y - mu) * slope
        xtw = x.T * (1 / (w * np.square(slope)) if family != "gaussian" else w)
        new = np.linalg.pinv(xtw @ x) @ (xtw @ z)
        ok = bool(np.allclose(new, beta, rtol=1e-10, atol=1e-10))
        beta, eta = new, x @ new
        mu = back(eta)
        if ok or family == "gaussian":
            ok = True
            break
    df = max(n - k, 1)
    phi = 1.0 if family in ("poisson", "binomial") else float((np.square(y - mu) / np.maximum(var(mu), 1e-10)).sum() / df)
    slope = {"gaussian": 1.0, "poisson": 1 / mu, "binomial": 1 / np.maximum(mu * (1 - mu), 1e-10), "gamma": -1 / mu**2}[family]
    xtw = x.T * (1 / (np.maximum(var(mu), 1e-10) * np.square(slope)) * np.ones(n))
    cov = np.linalg.pinv(xtw @ x) * phi
    if family == "gaussian":
        s2 = max(float(np.square(y - mu).mean()), 1e-300)
        ll = -n / 2 * (math.log(2 * math.pi * s2) + 1)
    elif family == "poisson":
        ll = float((y * np.log(np.maximum(mu, 1e-300)) - mu - np.array([math.lgamma(v + 1) for v in y])).sum())
    elif family == "binomial":
        ll = float((y * np.log(np.maximum(mu, 1e-300)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-300))).sum())
    else:
        a = 1 / max(phi, 1e-12)
        ll = float((a * np.log(a * np.maximum(y, 1e-300) / mu) - a * y / mu - np.log(np.maximum(y, 1e-300)) - math.lgamma(a)).sum())
    return beta, cov, ll, mu, ok


def _prepared(x: DataFrame, metadata: DataFrame, variables: list[str], categorical: list[str] | None):
    kinds = dict(metadata.dtypes)
    categorical = [v for v in variables if kinds[v] in ("string", "boolean")] if categorical is None else categorical
    levels = {v: sorted(r[0] for r in metadata.select(v).distinct().collect() if r[0] is not None) for v in categorical}
    return x.join(metadata, "obs").dropna(subset=["v", *variables]), levels


def glm(x: DataFrame, metadata: DataFrame, variables: list[str], family: str = "gaussian", categorical: list[str] | None = None, fdr: str = "fdr_bh") -> DataFrame:
    """Coefficients of every attribute's model, p-values adjusted inside each attribute."""
    rows, levels = _prepared(x, metadata, variables, categorical)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        names, m = design(g, variables, levels)
        y = g.v.to_numpy(float)
        beta, cov, ll, mu, ok = irls(m, y, family)
        se = np.sqrt(np.maximum(np.diag(cov), 0))
        stat = np.divide(beta, se, out=np.zeros_like(beta), where=se > 0)
        total = np.square(y - y.mean()).sum()
        return pd.DataFrame({"attr": g.attr.iloc[0], "term": names, "coef": beta, "std_err": se, "statistic": stat, "p_value": [norm_sf2(s) for s in stat], "ci_low": beta - 1.959963984540054 * se, "ci_high": beta + 1.959963984540054 * se, "nobs": len(y), "loglik": ll, "r2": 1 - np.square(y - mu).sum() / total if total else None, "converged": ok})

    return p_adjust(rows.groupBy("attr").applyInPandas(fit, f"attr {dict(x.dtypes)['attr']}, {RESULT}"), "p_value", fdr, "q_value", by="attr")


def mixed(x: DataFrame, metadata: DataFrame, variables: list[str], random: str, categorical: list[str] | None = None, fdr: str = "fdr_bh") -> DataFrame:
    """Random-intercept models by REML, profiled over the variance ratio of each attribute."""
    rows, levels = _prepared(x, metadata, [*variables], categorical)
    rows = rows.dropna(subset=[random])

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        names, m = design(g, variables, levels)
        y, n, k = g.v.to_numpy(float), len(g), m.shape[1]
        group = pd.factorize(g[random])[0]
        size = np.bincount(group)

        def solve(log_ratio: float):
            ratio = math.exp(log_ratio)
            shrink = ratio / (1 + ratio * size)
            sums = lambda c: np.bincount(group, c)
            inner = lambda a, b: a @ b - (shrink * sums(a)) @ sums(b)
            a = np.array([[inner(m[:, i], m[:, j]) for j in range(k)] for i in range(k)])
            b = np.array([inner(m[:, i], y) for i in range(k)])
            inverse = np.linalg.pinv(a)
            beta = inverse @ b
            r = y - m @ beta
            s2 = max(inner(r, r) / max(n - k, 1), 1e-300)
            ll = -0.5 * ((n - k) * (math.log(2 * math.pi * s2) + 1) + np.log1p(ratio * size).sum() + np.linalg.slogdet(a)[1])
            return ll, beta, inverse * s2, s2 * ratio

        lo, hi, golden = -15.0, 10.0, (5**0.5 - 1) / 2
        while hi - lo > 1e-8:
            a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
            lo, hi = (lo, b) if solve(a)[0] > solve(b)[0] else (a, hi)
        ll, beta, cov, group_var = solve((lo + hi) / 2)
        se = np.sqrt(np.maximum(np.diag(cov), 0))
        stat = np.divide(beta, se, out=np.zeros_like(beta), where=se > 0)
        none = [float("nan")]
        more = lambda v: [*v, *none]  # noqa: E731  the group variance has no test
        return pd.DataFrame({"attr": g.attr.iloc[0], "term": [*names, "Group Var"], "coef": [*beta, group_var], "std_err": more(se), "statistic": more(stat), "p_value": [*[norm_sf2(s) for s in stat], None], "ci_low": more(beta - 1.959963984540054 * se), "ci_high": more(beta + 1.959963984540054 * se), "nobs": n, "loglik": ll, "r2": None, "converged": True})

    return p_adjust(rows.groupBy("attr").applyInPandas(fit, f"attr {dict(x.dtypes)['attr']}, {RESULT}"), "p_value", fdr, "q_value", by="attr")


def graph(synopsis: DataFrame, test: str = "q_value", tol: float = 0.05, exclude: list | None = None) -> DataFrame:
    """Edges from terms to attributes whose test is below a tolerance, with size and sign of the coefficient."""
    rows = synopsis.where((F.col(test) < tol) & ~F.col("term").isin("Intercept", "Group Var"))
    rows = rows.where(~F.col("attr").isin(exclude)) if exclude else rows
    return rows.select(F.col("term").alias("node_a"), F.col("attr").cast("string").alias("node_b"), F.abs("coef").alias("weight"), F.signum("coef").cast("int").alias("sign"))


def predict(synopsis: DataFrame, metadata: DataFrame, variables: list[str]) -> DataFrame:
    """Linear predictors of every attribute for new observations with numeric variables."""
    terms = [F.struct(F.lit("Intercept").alias("term"), F.lit(1.0).alias("z"))] + [F.struct(F.lit(v).alias("term"), F.col(v).cast("double").alias("z")) for v in variables]
    long = metadata.select("obs", F.explode(F.array(*terms)).alias("t")).select("obs", "t.term", "t.z")
    return long.join(synopsis.select("attr", "term", "coef"), "term").groupBy("obs", "attr").agg(F.sum(F.col("z") * F.col("coef")).alias("v"))


def residuals(x: DataFrame, predicted: DataFrame) -> DataFrame:
    """Observed, predicted and left over values of every cell."""
    return x.join(predicted.withColumnRenamed("v", "predicted"), ["obs", "attr"]).withColumn("residual", F.col("v") - F.col("predicted"))
