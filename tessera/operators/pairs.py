"""Pairwise operators.  All pairs of attributes over shared observations, as edges ``node_a`` < ``node_b`` with ``weight``.

Pairs meet in an equi-join on the observation, so work follows the cells that
both have; distances that zeros matter for take dense input (``densify``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import kolmogorov_sf, norm_sf2, t_sf2
from .matrix import transpose
from .normalize import clr

def distance_of(name: str) -> Column:
    x, y = F.col("x"), F.col("y")
    gap = F.abs(x - y)
    return {
        "euclidean": F.sqrt(F.sum((x - y) * (x - y))),
        "sqeuclidean": F.sum((x - y) * (x - y)),
        "cityblock": F.sum(gap),
        "chebyshev": F.max(gap),
        "cosine": 1 - F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))),
        "correlation": 1 - F.corr("x", "y"),
        "braycurtis": F.try_divide(F.sum(gap), F.sum(F.abs(x + y))),
        "canberra": F.sum(F.coalesce(F.try_divide(gap, F.abs(x) + F.abs(y)), F.lit(0.0))),
        "hamming": F.avg(F.when(x != y, 1.0).otherwise(0.0)),
        "jaccard": F.coalesce(F.try_divide(F.sum(F.when((x != y) & ((x != 0) | (y != 0)), 1.0).otherwise(0.0)), F.sum(F.when((x != 0) | (y != 0), 1.0).otherwise(0.0))), F.lit(0.0)),
        "minkowski": F.sqrt(F.sum((x - y) * (x - y))),
        "dice": _boolean("dice"),
        "rogerstanimoto": _boolean("rogerstanimoto"),
        "russellrao": _boolean("russellrao"),
        "sokalsneath": _boolean("sokalsneath"),
        "yule": _boolean("yule"),
    }[name]


def _boolean(name: str) -> Column:
    t, f = F.col("x") != 0, F.col("y") != 0
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    tt, tf, ft, ff = n(t & f), n(t & ~f), n(~t & f), n(~t & ~f)
    r = tf + ft
    return {"dice": F.try_divide(r, 2 * tt + r), "rogerstanimoto": F.try_divide(2 * r, tt + ff + 2 * r), "russellrao": F.try_divide(tf + ft + ff, tt + ff + r), "sokalsneath": F.try_divide(2 * r, tt + 2 * r), "yule": F.coalesce(F.try_divide(2 * tf * ft, tt * ff + tf * ft), F.lit(0.0))}[name]


DISTANCES = ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "cosine", "correlation", "braycurtis", "canberra", "hamming", "jaccard", "minkowski", "dice", "rogerstanimoto", "russellrao", "sokalsneath", "yule")
CORRELATIONS = ("pearson", "spearman", "kendall", "bicor")


def cell_pairs(x: DataFrame) -> DataFrame:
    """Cells of two attributes of one observation: ``obs``, ``node_a``, ``node_b``, ``x``, ``y``."""
    a = x.select("obs", F.col("attr").alias("node_a"), F.col("v").alias("x"))
    b = x.select("obs", F.col("attr").alias("node_b"), F.col("v").alias("y"))
    return a.join(b, "obs").where("node_a < node_b and x is not null and y is not null")


def distance(x: DataFrame, metric: str = "euclidean") -> DataFrame:
    return cell_pairs(x).groupBy("node_a", "node_b").agg(distance_of(metric).alias("weight"))


def ranked(x: DataFrame) -> DataFrame:
    """Average ranks inside each attribute."""
    w = Window.partitionBy("attr").orderBy("v")
    ties = Window.partitionBy("attr", "v")
    return x.withColumn("v", F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def bicor_units(x: DataFrame) -> DataFrame:
    """Weighted, median-centred attributes of unit length, whose products sum to the biweight midcorrelation."""
    w = Window.partitionBy("attr")
    d = x.withColumn("d", F.col("v") - F.median("v").over(w))
    d = d.withColumn("m", F.median(F.abs("d")).over(w))
    u = F.try_divide("d", 9 * F.col("m"))
    d = d.withColumn("b", F.when(F.abs(u) < 1, F.col("d") * F.pow(1 - u * u, 2)).otherwise(0.0))
    return d.select("obs", "attr", F.try_divide("b", F.sqrt(F.sum(F.col("b") * F.col("b")).over(w))).alias("v"))


def correlation(x: DataFrame, method: str = "pearson") -> DataFrame:
    if method == "bicor":
        return cell_pairs(bicor_units(x)).groupBy("node_a", "node_b").agg(F.sum(F.col("x") * F.col("y")).alias("weight"))
    if method == "kendall":
        return _kendalls(x)
    rows = cell_pairs(ranked(x) if method == "spearman" else x)
    return rows.groupBy("node_a", "node_b").agg(F.corr("x", "y").alias("weight"))


def _by_pair(x: DataFrame, f) -> DataFrame:
    """Any function of two value vectors, on arrays of each pair."""

    @F.pandas_udf("double")
    def value(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(np.asarray(p, float), np.asarray(q, float)) for p, q in zip(a, b, strict=True)], dtype="float64")

    vectors = x.groupBy("attr").agg(F.transform(F.array_sort(F.collect_list(F.struct("obs", "v"))), lambda c: c["v"]).alias("vs"))
    a, b = vectors.select(F.col("attr").alias("node_a"), F.col("vs").alias("xs")), vectors.select(F.col("attr").alias("node_b"), F.col("vs").alias("ys"))
    return a.join(b, F.col("node_a") < F.col("node_b")).select("node_a", "node_b", value("xs", "ys").alias("weight"))


def _kendalls(x: DataFrame) -> DataFrame:
    """Kendall's tau-b of all pairs over shared observations: equal pairs of values are counted first, discordant ones by their order, n log n."""
    kind = dict(x.dtypes)["attr"]
    counts = cell_pairs(x.withColumn("v", F.col("v").cast("double"))).groupBy("node_a", "node_b", "x", "y").agg(F.count(F.lit(1)).alias("c"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node_a": g.node_a.iloc[:1], "node_b": g.node_b.iloc[:1], "weight": [_kendall(g.x.to_numpy(), g.y.to_numpy(), g.c.to_numpy())]})

    return counts.groupBy("node_a", "node_b").applyInPandas(one, f"node_a {kind}, node_b {kind}, weight double")


def _kendall(a: np.ndarray, b: np.ndarray, count: np.ndarray | None = None) -> float:
    """Tau-b of pairs of values that occur ``count`` times."""
    count = np.ones(len(a), np.int64) if count is None else count.astype(np.int64)
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        return np.nan
    by = np.lexsort((b, a))
    a, b, count = a[by], b[by], count[by]
    n = int(count.sum())
    alike = lambda *vs: sum(int(t) ** 2 for t in _weights(count, *vs).tolist())  # noqa: E731  (ordered pairs that are equal, each with itself too)
    in_a, in_b, both = alike(a), alike(b), alike(a, b)
    concordant = n * n - in_a - in_b + both - 4 * _inversions(np.unique(b, return_inverse=True)[1], count)
    d = float(n * n - in_a) ** 0.5 * float(n * n - in_b) ** 0.5
    return concordant / d if d else np.nan


def _weights(count: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Sums of counts of equal values."""
    by = np.lexsort(values)
    new = np.zeros(len(by), bool)
    new[:1] = True
    for v in values:
        new[1:] |= v[by][1:] != v[by][:-1]
    return np.add.reduceat(count[by], np.flatnonzero(new)) if len(by) else count


def _inversions(rank: np.ndarray, count: np.ndarray) -> int:
    """Pairs that stand in descending order, by the highest bit in which their ranks differ; a stable sort by that bit follows."""
    total = 0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):  # ranks are sorted by their higher bits here
        high = (rank >> bit & 1).astype(bool)
        group = rank >> (bit + 1)
        ones = np.cumsum(np.where(high, count, 0))
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        before = np.repeat(np.append(0, ones)[first], np.diff(np.append(first, len(rank))))
        total += sum(int(t) for t in ((ones - before)[~high] * count[~high]).tolist())
        by = np.argsort(rank >> bit, kind="stable")
        rank, count = rank[by], count[by]
    return total


def _midranks(v: np.ndarray) -> tuple[np.ndarray, float]:
    _, place, count = np.unique(v, return_inverse=True, return_counts=True)
    end = np.cumsum(count)
    return (end - (count - 1) / 2)[place], float((count**3 - count).sum())


def _mannwhitney(a, b):
    r, ties = _midranks(np.concatenate((a, b)))
    n, m = len(a), len(b)
    u = r[:n].sum() - n * (n + 1) / 2
    s = np.sqrt(n * m / 12 * ((n + m + 1) - ties / ((n + m) * (n + m - 1))))
    return norm_sf2((abs(u - n * m / 2) - 0.5) / s) if s else np.nan


def _ranksums(a, b):
    r, _ = _midranks(np.concatenate((a, b)))
    n, m = len(a), len(b)
    return norm_sf2((r[:n].sum() - n * (n + m + 1) / 2) / np.sqrt(n * m * (n + m + 1) / 12))


def _wilcoxon(a, b):
    d = (a - b)[a != b]
    n = len(d)
    if not n:
        return np.nan
    r, ties = _midranks(np.abs(d))
    w = min(r[d > 0].sum(), r[d < 0].sum())
    return norm_sf2((w - n * (n + 1) / 4) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48))


def _ks(a, b):
    every = np.sort(np.concatenate((a, b)))
    gap = np.abs(np.searchsorted(np.sort(a), every, "right") / len(a) - np.searchsorted(np.sort(b), every, "right") / len(b)).max()
    return kolmogorov_sf(gap * np.sqrt(len(a) * len(b) / (len(a) + len(b))))


def _ttest(a, b, kind: str):
    n, m = len(a), len(b)
    if kind == "rel":
        d = a - b
        s = d.std(ddof=1) / np.sqrt(n)
        return t_sf2(d.mean() / s, n - 1) if s else np.nan
    pooled = ((n - 1) * a.var(ddof=1) + (m - 1) * b.var(ddof=1)) / (n + m - 2) * (1 / n + 1 / m)
    return t_sf2((a.mean() - b.mean()) / np.sqrt(pooled), n + m - 2) if pooled else np.nan


TESTS = {"ks_2samp": _ks, "mannwhitneyu": _mannwhitney, "ranksums": _ranksums, "wilcoxon": _wilcoxon, "ttest_ind": lambda a, b: _ttest(a, b, "ind"), "ttest_rel": lambda a, b: _ttest(a, b, "rel")}


def pairwise(x: DataFrame, metric="euclidean", axis: int = 1, association: str = "infer", signed: bool | None = True) -> DataFrame:
    """Edges of all pairs of attributes (``axis=0``: of observations) by a metric's name or a function of two vectors.

    ``association="dissimilarity"`` turns correlations r into 1 - f(r): (r+1)/2
    if signed, |r| if not, r itself if ``signed`` is None.
    """
    x = transpose(x) if axis == 0 else x
    if callable(metric):
        return _by_pair(x, metric)
    if metric in TESTS:
        return _by_pair(x, TESTS[metric])
    if metric in CORRELATIONS:
        out = correlation(x, metric)
        if association == "dissimilarity":
            r = F.col("weight")
            out = out.withColumn("weight", 1 - ((r + 1) / 2 if signed else r if signed is None else F.abs(r)))
        return out
    return distance(x, metric)


def vlr(x: DataFrame) -> DataFrame:
    """Variance of the log-ratio of each pair (zeros left out)."""
    logs = x.where("v > 0").withColumn("v", F.ln("v"))
    return cell_pairs(logs).groupBy("node_a", "node_b").agg(F.var_samp(F.col("x") - F.col("y")).alias("weight"))


def proportionality(x: DataFrame, measure: str = "rho") -> DataFrame:
    """rho_p = 1 - vlr / (var a + var b), or phi = vlr / var a, of centred log-ratios."""
    rows = cell_pairs(clr(x)).groupBy("node_a", "node_b").agg(F.var_samp(F.col("x") - F.col("y")).alias("l"), F.var_samp("x").alias("a"), F.var_samp("y").alias("b"))
    value = 1 - F.try_divide("l", F.col("a") + F.col("b")) if measure == "rho" else F.try_divide("l", "a")
    return rows.select("node_a", "node_b", value.alias("weight"))


def difference(x: DataFrame, control: DataFrame, treatment: DataFrame) -> DataFrame:
    """Treatment minus control of every attribute, for all pairs of observations."""
    t = x.join(treatment.select("obs"), "obs", "left_semi").select(F.col("obs").alias("treatment"), "attr", F.col("v").alias("x"))
    c = x.join(control.select("obs"), "obs", "left_semi").select(F.col("obs").alias("control"), "attr", F.col("v").alias("y"))
    return t.join(c, "attr").select("treatment", "control", "attr", (F.col("x") - F.col("y")).alias("v"))


def log_fold_change(x: DataFrame, control: DataFrame, treatment: DataFrame, log=F.log2) -> DataFrame:
    """Differences of logarithms; the logarithm of zero is minus infinity."""
    v = F.when(F.col("v") == 0, F.lit(float("-inf"))).otherwise(log(F.col("v")))
    return difference(x.withColumn("v", v), control, treatment)
