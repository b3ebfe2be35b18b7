"""Differential abundance between two classes of observations.

``clr_monte_carlo`` follows the published log-ratio method: Dirichlet draws of
each observation, centred log-ratios, and tests averaged over draws.
``exact_test`` and ``likelihood_ratio`` are negative-binomial tests between two
classes, ``glm_test`` one of a contrast under any design.  Dispersions are one for
all attributes by moments, or by the published adjusted profile likelihoods on a
grid: common, trended along abundance, or each attribute's own drawn towards the
trend.  Draws are random (seeded), so results agree in distribution with other
implementations, not bit by bit.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, t_sf2
from ..storage import kept
from .matrix import densify
from .normalize import size_factors
from .pairs import _mannwhitney
from .stats import p_adjust


def clr_monte_carlo(x: DataFrame, y: DataFrame, reference, samples: int = 128, seed: int = 0) -> DataFrame:
    """Per attribute: mean Welch and rank-sum p and their BH values over draws, difference, and effect size."""
    full = densify(x)
    kind_o, kind_a = dict(full.dtypes)["obs"], dict(full.dtypes)["attr"]

    def draw(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("attr")
        rng = np.random.RandomState(zlib.crc32(f"{seed}:{g.obs.iloc[0]}".encode()))
        z = np.log(np.maximum(rng.gamma(g.v.to_numpy(float)[:, None] + 0.5, size=(len(g), samples)), 1e-300))
        z -= z.mean(axis=0)
        return pd.DataFrame({"obs": g.obs, "attr": g.attr, "z": list(z)})

    draws = full.groupBy("obs").applyInPandas(draw, f"obs {kind_o}, attr {kind_a}, z array<double>").join(y, "obs")

    def test(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.stack(g.loc[m, "z"].to_list()) for m in (g["class"] != reference, g["class"] == reference))
        n, m = len(a), len(b)
        u, w = a.var(axis=0, ddof=1) / n, b.var(axis=0, ddof=1) / m
        t = (a.mean(axis=0) - b.mean(axis=0)) / np.sqrt(u + w)
        df = (u + w) ** 2 / (u**2 / (n - 1) + w**2 / (m - 1))
        welch = [t_sf2(p, q) for p, q in zip(t, df, strict=True)]
        ranks = [_mannwhitney(a[:, k], b[:, k]) for k in range(a.shape[1])]
        between = np.median(a[:, None, :] - b[None, :, :])
        within = np.median(np.maximum(np.abs(a - a[::-1]).max(axis=0), np.abs(b - b[::-1]).max(axis=0)))
        return pd.DataFrame({"attr": [g.attr.iloc[0]], "we_p": [float(np.mean(welch))], "wi_p": [float(np.nanmean(ranks))], "difference": [float(between)], "effect": [float(between / within) if within else None]})

    out = draws.groupBy("attr").applyInPandas(test, f"attr {kind_a}, we_p double, wi_p double, difference double, effect double")
    return p_adjust(p_adjust(out, "we_p", "fdr_bh", "we_bh"), "wi_p", "fdr_bh", "wi_bh")


def _counts(x: DataFrame, y: DataFrame, reference) -> DataFrame:
    """Counts at a common library size, with the class as 0 (reference) or 1."""
    factors = size_factors(x, "tmm").withColumn("eff", F.col("lib") * F.col("factor"))
    scale = factors.agg(F.exp(F.avg(F.ln("eff"))).alias("common"))
    rows = densify(x).join(factors.select("obs", "eff"), "obs").crossJoin(F.broadcast(scale)).join(y, "obs")
    return rows.select("obs", "attr", (F.col("v") * F.col("common") / F.col("eff")).alias("v"), "common", F.when(F.col("class") == reference, 0).otherwise(1).alias("treated"))


def _dispersion(rows: DataFrame) -> float:
    """One dispersion by moments inside classes: (variance - mean) / mean squared, over attributes."""
    s = rows.groupBy("attr", "treated").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s")).where("m > 0 and s is not null")
    r = s.agg(F.sum(F.col("s") - F.col("m")).alias("a"), F.sum(F.col("m") * F.col("m")).alias("b")).head()
    return max(1e-6, (r.a or 0.0) / (r.b or 1.0))


def _finish(out: DataFrame) -> DataFrame:
    return p_adjust(out, "p_value", "fdr_bh", "fdr")


def _split_tail(total: int, own: int, a: float, b: float, chunk: int = 1 << 16) -> float:
    """Probability of splits of a total no likelier than the one seen, by steps of the log ratio in bounded pieces."""

    def pieces():
        at = 0.0
        for lo in range(0, total + 1, chunk):
            k = np.arange(lo, min(total + 1, lo + chunk), dtype=float)
            step = np.log((k[:-1] + a) / (k[:-1] + 1)) + np.log((total - k[:-1]) / (total - k[:-1] - 1 + b))
            log = at + np.concatenate(([0.0], np.cumsum(step)))
            yield lo, log
            last = k[-1]
            if last < total:
                at = log[-1] + math.log((last + a) / (last + 1)) + math.log((total - last) / (total - last - 1 + b))

    top, seen = -math.inf, 0.0
    for lo, log in pieces():
        top = max(top, float(log.max()))
        if lo <= own < lo + len(log):
            seen = float(log[own - lo])
    whole = tail = 0.0
    for _, log in pieces():
        p = np.exp(log - top)
        whole += float(p.sum())
        tail += float(p[log <= seen + 1e-7].sum())
    return min(1.0, tail / whole)


def exact_test(x: DataFrame, y: DataFrame, reference, dispersion: str = "moments") -> DataFrame:
    """log2 fold change, mean log2 CPM, and the exact negative-binomial p of the split of each attribute's total; dispersions by ``moments`` or as in ``dispersions``."""
    rows = _counts(x, y, reference)
    kind = dict(rows.dtypes)["attr"]
    if dispersion == "moments":
        rows = rows.withColumn("phi", F.lit(float(_dispersion(rows))))
    else:
        rows = rows.join(dispersions(_designed(x, y)[0], dispersion).select("attr", "phi"), "attr")

    def test(g: pd.DataFrame) -> pd.DataFrame:
        a, b, phi = g.loc[g.treated == 1, "v"], g.loc[g.treated == 0, "v"], float(g.phi.iloc[0])
        total = int(round(a.sum() + b.sum()))
        p = _split_tail(total, min(total, int(round(a.sum()))), len(a) / phi, len(b) / phi)
        cpm = 1e6 / g.common.iloc[0]
        return pd.DataFrame({"attr": [g.attr.iloc[0]], "log_fc": [math.log2((a.mean() * cpm + 0.5) / (b.mean() * cpm + 0.5))], "log_cpm": [math.log2(g.v.mean() * cpm + 0.5)], "p_value": [p]})

    return _finish(rows.groupBy("attr").applyInPandas(test, f"attr {kind}, log_fc double, log_cpm double, p_value double"))


#: Dispersions that profile likelihoods are computed for.
GRID = 0.1 * 2.0 ** np.arange(-10, 7, 0.5)


def _designed(x: DataFrame, y: DataFrame, design: DataFrame | None = None) -> tuple[DataFrame, list]:
    """Counts with their offset and row of the design (``obs``, ``column``, ``v``; by default a column a class), and the columns in order."""
    if design is None:
        design = y.select("obs", F.col("class").alias("column"), F.lit(1.0).alias("v"))
    columns = [r[0] for r in design.select("column").distinct().orderBy("column").collect()]  # as many as the model has terms
    packed = design.groupBy("obs").agg(F.map_from_entries(F.collect_list(F.struct("column", F.col("v").cast("double")))).alias("m"))
    row = packed.select("obs", F.array(*[F.coalesce(F.col("m")[c], F.lit(0.0)) for c in columns]).alias("row"))
    factors = size_factors(x, "tmm").select("obs", (F.col("lib") * F.col("factor")).alias("eff"))
    return densify(x).join(factors, "obs").join(row, "obs").select("obs", "attr", "v", "eff", "row"), columns


def _fit(v: np.ndarray, m: np.ndarray, offset: np.ndarray, phi: float) -> tuple[np.ndarray, float, float]:
    """Coefficients of a log-linear negative-binomial mean, its log likelihood (up to a constant of v and phi) and half the log determinant of the information."""
    beta = np.linalg.lstsq(m, np.log((v + 0.5) / np.exp(offset)), rcond=None)[0]

    def value(b: np.ndarray) -> tuple[np.ndarray, float]:
        mu = np.maximum(np.exp(np.clip(m @ b + offset, -700, 700)), 1e-12)
        return mu, float((v * (np.log(mu) - np.log1p(phi * mu)) - np.log1p(phi * mu) / phi).sum())

    mu, ll = value(beta)
    for _ in range(100):
        w = mu / (1 + phi * mu)
        info = m.T @ (m * w[:, None]) + 1e-10 * np.eye(m.shape[1])
        step = np.linalg.solve(info, m.T @ ((v - mu) / (1 + phi * mu)))
        size = 1.0
        while size > 1e-6:
            new_mu, new = value(beta + size * step)
            if new >= ll - 1e-12:
                break
            size /= 2
        else:
            break
        gain, beta, mu, ll = new - ll, beta + size * step, new_mu, new
        if gain < 1e-10 * (abs(ll) + 1):
            break
    w = mu / (1 + phi * mu)
    return beta, ll, 0.5 * float(np.linalg.slogdet(m.T @ (m * w[:, None]) + 1e-10 * np.eye(m.shape[1]))[1])


def _profile(v: np.ndarray, m: np.ndarray, offset: np.ndarray) -> list[float]:
    """Adjusted profile log likelihoods of the grid's dispersions."""
    out = []
    for phi in GRID:
        _, ll, half = _fit(v, m, offset, phi)
        r = 1 / phi
        constant = sum(math.lgamma(c + r) - math.lgamma(r) for c in v) + float(v.sum()) * math.log(phi)
        out.append(ll + constant - half)
    return out


def dispersions(rows: DataFrame, method: str = "tagwise", prior_df: float = 10.0, bins: int = 20) -> DataFrame:
    """``attr``, ``abundance`` (log2 mean CPM) and ``phi`` of designed counts, by ``common``, ``trended`` or ``tagwise`` likelihood.

    Each attribute's likelihoods are one array; sums of arrays over all
    attributes, or over those of like abundance, give the common value and the
    trend, and ``prior_df`` weighs the trend against an attribute's own.
    """
    if method not in ("common", "trended", "tagwise"):
        raise ValueError(f"unknown dispersion {method!r}")
    kind = dict(rows.dtypes)["attr"]

    def profile(g: pd.DataFrame) -> pd.DataFrame:
        v, m, eff = g.v.to_numpy(float), np.stack(g["row"].to_list()).astype(float), g.eff.to_numpy(float)
        free = max(1, len(v) - np.linalg.matrix_rank(m))
        return pd.DataFrame({"attr": [g.attr.iloc[0]], "abundance": [math.log2(float((v / eff).mean()) * 1e6 + 0.5)], "free": [free], "likelihood": [_profile(v, m, np.log(eff))]})

    each = kept(rows.groupBy("attr").applyInPandas(profile, f"attr {kind}, abundance double, free int, likelihood array<double>"))
    edges = each.agg(F.percentile_approx("abundance", [i / bins for i in range(1, bins)], 10000).alias("cuts")).head().cuts or []
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(edges))]), lambda c: F.col("abundance") > c)) if edges and method != "common" else F.lit(0)
    placed = each.withColumn("bin", part)
    shared = placed.groupBy("bin").agg(F.array(*[F.avg(F.col("likelihood")[i]) for i in range(len(GRID))]).alias("together"))
    own = F.col("together") if method != "tagwise" else F.zip_with("likelihood", "together", lambda a, b: a + b * F.lit(float(prior_df)) / F.col("free"))

    @F.pandas_udf("double")
    def peak(values: pd.Series) -> pd.Series:
        out, steps = [], np.log(GRID)
        for row in values:
            row = np.asarray(row, float)
            i = int(row.argmax())
            at = steps[i]
            if 0 < i < len(row) - 1:
                down, up = row[i] - row[i - 1], row[i] - row[i + 1]
                at += (steps[1] - steps[0]) * (down - up) / (2 * (down + up)) if down + up > 0 else 0.0
            out.append(float(np.exp(at)))
        return pd.Series(out, dtype="float64")

    return placed.join(F.broadcast(shared), "bin").select("attr", "abundance", peak(own).alias("phi"))  # a row a bin


def glm_test(x: DataFrame, y: DataFrame, reference, design: DataFrame | None = None, contrasts: dict | None = None, dispersion: str = "tagwise", scope: str = "global") -> DataFrame:
    """Likelihood-ratio tests of contrasts: ``treatment``, ``attr``, ``log_fc``, ``log_cpm``, ``statistic``, ``p_value``, ``fdr``.

    Without contrasts (name to weights of design columns) every class is
    compared with the reference.  With ``scope`` ``local`` the dispersions and
    fits of a comparison see its two classes alone (default designs only).
    """
    names = [r[0] for r in y.select("class").distinct().orderBy("class").collect()]  # a row a class
    if reference not in names:
        raise ValueError(f"no observation of class {reference!r}")
    if scope == "local":
        if design is not None or contrasts is not None:
            raise ValueError("local dispersions need the default design")
        out = None
        for c in names:
            if c != reference:
                two = y.where(F.col("class").isin(c, reference))
                one = glm_test(x.join(two.select("obs"), "obs", "left_semi"), two, reference, None, {str(c): {c: 1.0, reference: -1.0}}, dispersion)
                out = one if out is None else out.unionByName(one)
        return out
    rows, columns = _designed(x, y, design)
    rows = kept(rows)
    contrasts = contrasts or {str(c): {c: 1.0, reference: -1.0} for c in names if c != reference}
    unknown = {c for w in contrasts.values() for c in w} - set(columns)
    if unknown:
        raise ValueError(f"not in the design: {sorted(map(str, unknown))}")
    weights = {n: np.array([float(w.get(c, 0.0)) for c in columns]) for n, w in contrasts.items()}
    phi, kind = dispersions(rows, dispersion), dict(rows.dtypes)["attr"]

    def test(g: pd.DataFrame) -> pd.DataFrame:
        v, m, eff, phi = g.v.to_numpy(float), np.stack(g["row"].to_list()).astype(float), g.eff.to_numpy(float), float(g.phi.iloc[0])
        beta, full, _ = _fit(v, m, np.log(eff), phi)
        found = []
        for name, c in weights.items():
            basis = np.linalg.svd(c[None])[2][1:].T  # designs under which the contrast is zero
            less = _fit(v, m @ basis, np.log(eff), phi)[1] if basis.shape[1] else float("-inf")
            stat = max(0.0, 2 * (full - less))
            found.append((name, g.attr.iloc[0], float(c @ beta) / math.log(2), float(g.abundance.iloc[0]), stat, chi2_sf(stat, 1)))
        return pd.DataFrame(found, columns=["treatment", "attr", "log_fc", "log_cpm", "statistic", "p_value"])

    out = rows.join(phi, "attr").groupBy("attr").applyInPandas(test, f"treatment string, attr {kind}, log_fc double, log_cpm double, statistic double, p_value double")
    return p_adjust(kept(out), "p_value", "fdr_bh", "fdr", by="treatment")


def likelihood_ratio(x: DataFrame, y: DataFrame, reference) -> DataFrame:
    """The same with the likelihood-ratio test of two negative-binomial means against one."""
    rows = _counts(x, y, reference)
    phi, kind = _dispersion(rows), dict(rows.dtypes)["attr"]

    def loglik(v: np.ndarray, mu: float) -> float:
        mu = max(mu, 1e-12)
        return float((v * np.log(mu / (1 + phi * mu)) - np.log1p(phi * mu) / phi).sum())

    def test(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g.loc[g.treated == 1, "v"].to_numpy(), g.loc[g.treated == 0, "v"].to_numpy()
        stat = 2 * (loglik(a, a.mean()) + loglik(b, b.mean()) - loglik(g.v.to_numpy(), g.v.mean()))
        cpm = 1e6 / g.common.iloc[0]
        return pd.DataFrame({"attr": [g.attr.iloc[0]], "log_fc": [math.log2((a.mean() * cpm + 0.5) / (b.mean() * cpm + 0.5))], "log_cpm": [math.log2(g.v.mean() * cpm + 0.5)], "statistic": [stat], "p_value": [chi2_sf(max(stat, 0.0), 1)]})

    return _finish(rows.groupBy("attr").applyInPandas(test, f"attr {kind}, log_fc double, log_cpm double, statistic double, p_value double"))


def differential_abundance(x: DataFrame, y: DataFrame, reference, method: str = "clr", **options) -> DataFrame:
    """Dispatches on the method; the classes must name every observation, and all others than the reference are the treatment."""
    if not x.select("obs").distinct().join(y, "obs", "left_anti").isEmpty():
        raise ValueError("observations without a class")
    return {"clr": clr_monte_carlo, "exact": exact_test, "lrt": likelihood_ratio, "glm": glm_test}[method](x, y, reference, **options)
