"""Ordination: principal components and coordinates, scaling and Procrustes fits.

Cross products of attributes are summed by the cluster; decompositions are of
matrices as large as an axis, on the driver, up to ``LIMIT``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrix import densify, matmul
from .tree import LIMIT, square


@dataclass
class Components:
    loadings: DataFrame  # attr, pc, loading, contribution
    explained: DataFrame  # pc, ratio
    scores: DataFrame  # obs, attr (the component), v
    importance: DataFrame  # attr, importance


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns whose entry of largest size is positive."""
    return vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)


def pca(x: DataFrame, center: bool = True, scale: bool = False, n_components: int = -1) -> Components:
    x = densify(x)
    w = Window.partitionBy("attr")
    v = F.col("v") - (F.avg("v").over(w) if center else F.lit(0.0))
    x = x.withColumn("v", F.try_divide(v, F.stddev_pop("v").over(w)) if scale else v)
    a, b = x.select("obs", F.col("attr").alias("a"), F.col("v").alias("p")), x.select("obs", F.col("attr").alias("b"), F.col("v").alias("q"))
    cross = a.join(b, "obs").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("p") * F.col("q")).alias("s")).limit(LIMIT * LIMIT).toPandas()
    attrs = sorted(set(cross.a) | set(cross.b))
    if len(attrs) > LIMIT:
        raise ValueError(f"more than {LIMIT} attributes")
    at = {n: i for i, n in enumerate(attrs)}
    m = np.zeros((len(attrs), len(attrs)))
    i, j = cross.a.map(at), cross.b.map(at)
    m[i, j] = m[j, i] = cross.s.fillna(0.0)
    values, vectors = np.linalg.eigh(m)
    values, vectors = np.maximum(values[::-1], 0), _signed(vectors[:, ::-1])
    n = min(len(attrs), x.select("obs").distinct().count())
    n = n if n_components < 0 else min(n, n_components)
    spark, kind = x.sparkSession, dict(x.dtypes)["attr"]
    share = np.abs(vectors) / np.abs(vectors).sum(axis=0)
    rows = [(attrs[i], f"PC{k + 1}", float(vectors[i, k]), float(share[i, k])) for i in range(len(attrs)) for k in range(n)]
    loadings = spark.createDataFrame(rows, f"attr {kind}, pc string, loading double, contribution double")
    total = values.sum() or 1.0
    explained = spark.createDataFrame([(f"PC{k + 1}", float(values[k] / total)) for k in range(n)], "pc string, ratio double")
    scores = matmul(x, loadings.select(F.col("attr").alias("obs"), F.col("pc").alias("attr"), F.col("loading").alias("v")))
    return Components(loadings, explained, scores, loadings.groupBy("attr").agg(F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("importance")))


def cumulative(explained: DataFrame, target: float | None = None) -> DataFrame:
    """Cumulative explained variance in component order; with a target, the first component that reaches it."""
    number = F.regexp_extract("pc", r"(\d+)$", 1).cast("int")
    rows = explained.withColumn("k", number)
    rows = rows.withColumn("cumulative", F.sum("ratio").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return rows if target is None else rows.where(F.col("cumulative") >= target).orderBy("k").limit(1)


def top_features(c: Components, k: int, mode: str = "weighted") -> DataFrame:
    """The k leading attributes by contributions to PC1 and PC2 (weighted, or half each) or by importance."""
    rows = c.loadings.join(c.explained, "pc").where("pc in ('PC1', 'PC2')")
    if mode == "importance":
        return c.importance.orderBy(F.desc("importance"), "attr").limit(k).select("attr")
    if mode == "weighted":
        return rows.groupBy("attr").agg(F.sum(F.col("contribution") * F.col("ratio")).alias("s")).orderBy(F.desc("s"), "attr").limit(k).select("attr")
    rank = F.row_number().over(Window.partitionBy("pc").orderBy(F.desc("contribution"), "attr"))
    return rows.withColumn("r", rank).where((F.col("r") <= k // 2) | ((F.col("pc") == "PC1") & (F.col("r") <= k // 2 + k % 2))).select("attr").distinct()


def pcoa(edges: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Labels, coordinates and shares of variance of principal coordinates."""
    labels, d = square(edges)
    n = len(labels)
    c = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(c @ (-0.5 * d**2) @ c)
    values, vectors = values[::-1], _signed(vectors[:, ::-1])
    keep = np.maximum(values, 0)
    return labels, vectors * np.sqrt(keep), keep / (keep.sum() or 1.0)


def mds(edges: DataFrame, n_components: int = 2, steps: int = 300, seed: int = 0) -> tuple[list, np.ndarray]:
    """Metric scaling by stress majorisation from a seeded start."""
    labels, d = square(edges)
    n = len(labels)
    x = np.random.RandomState(seed).uniform(size=(n, n_components))
    for _ in range(steps):
        e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(e, 1)
        b = -d / np.maximum(e, 1e-12)
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(axis=1))
        x = b @ x / n
    return labels, x


def neighbour_embedding(edges: DataFrame, n_components: int = 2, perplexity: float = 30.0, steps: int = 500, rate: float = 200.0, seed: int = 0) -> tuple[list, np.ndarray]:
    """t-distributed neighbour embedding of a small distance matrix: Gaussian neighbourhoods of a perplexity, gradient descent with momentum from seeded principal coordinates."""
    labels, d = square(edges)
    n = len(labels)
    if n < 3:
        return labels, np.zeros((n, n_components))
    goal, p = np.log(min(perplexity, (n - 1) / 3)), np.zeros((n, n))
    for i in range(n):
        row = np.delete(d[i], i) ** 2
        row = row - row.min()
        lo, hi = 0.0, np.inf
        beta = 1.0 / max(row.mean(), 1e-300)
        for _ in range(100):
            w = np.exp(-row * beta)
            w /= w.sum()
            entropy = -(w * np.log(np.maximum(w, 1e-300))).sum()
            if abs(entropy - goal) < 1e-7:
                break
            if entropy > goal:
                lo, beta = beta, beta * 2 if hi == np.inf else (beta + hi) / 2
            else:
                hi, beta = beta, (beta + lo) / 2
        p[i, np.arange(n) != i] = w
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    start = pcoa(edges)[1][:, :n_components]
    start = np.hstack([start, np.zeros((n, n_components - start.shape[1]))])
    y = start / (start[:, 0].std() or 1.0) * 1e-4 + np.random.RandomState(seed).normal(scale=1e-6, size=(n, n_components))
    move, gain = np.zeros_like(y), np.ones_like(y)
    for step in range(steps):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
        np.fill_diagonal(q, 0)
        g = (p * (12 if step < steps // 4 else 1) - q / q.sum()) * q
        slope = 4 * (g.sum(axis=1)[:, None] * y - g @ y)
        gain = np.maximum(0.01, np.where(slope * move > 0, gain * 0.8, gain + 0.2))
        move = (0.5 if step < steps // 4 else 0.8) * move - min(rate, n) * gain * slope
        y = y + move
        y -= y.mean(axis=0)
    return labels, y


def eigenprofiles(x: DataFrame, y: DataFrame) -> DataFrame:
    """Per class: the first component of its attributes as rows, with its share of variance."""
    kind = dict(x.dtypes)["attr"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = g.pivot(index="attr", columns="obs", values="v").fillna(0.0).sort_index()
        c = m.to_numpy() - m.to_numpy().mean(axis=0)
        u, s, vt = np.linalg.svd(c, full_matrices=False)
        sign = np.sign(vt[0][np.abs(vt[0]).argmax()]) or 1.0
        total = (s**2).sum()
        return pd.DataFrame({"class": g["class"].iloc[0], "attr": m.index, "v": u[:, 0] * s[0] * sign, "explained": s[0] ** 2 / total if total else 0.0})

    return x.join(y, "obs").groupBy("class").applyInPandas(run, f"class {dict(y.dtypes)['class']}, attr {kind}, v double, explained double")


@dataclass
class Fit:
    rotation: np.ndarray
    scale: float
    ss: float
    rmse: float
    fitted: np.ndarray
    residuals: np.ndarray


def procrustes(a: np.ndarray, b: np.ndarray, scale: bool = True, symmetric: bool = True) -> Fit:
    """Rotates (and scales) b to a, both centred; symmetric fits have unit trace."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    if symmetric:
        a, b = a / np.sqrt((a**2).sum()), b / np.sqrt((b**2).sum())
    u, s, vt = np.linalg.svd(a.T @ b)
    rotation = vt.T @ u.T
    c = s.sum() / (b**2).sum() if scale else 1.0
    ss = (a**2).sum() + c**2 * (b**2).sum() - 2 * c * s.sum()
    fitted = c * b @ rotation
    return Fit(rotation, float(c), float(ss), float(np.sqrt(ss / len(a))), fitted, np.sqrt(((a - fitted) ** 2).sum(axis=1)))


def protest(spark, a: np.ndarray, b: np.ndarray, n_iter: int = 999, replace: bool = False) -> float:
    """Permutation p of a symmetric fit; permutation i has seed i."""
    fit = procrustes(a, b)
    level = np.sqrt(max(0.0, 1 - fit.ss)) - np.sqrt(np.finfo(float).eps)

    def run(frames):
        for f in frames:
            hits = 0
            for i in f.id:
                rng = np.random.RandomState(int(i))
                rows = rng.choice(len(b), len(b), replace=replace)
                x, y = a - a.mean(axis=0), b[rows] - b[rows].mean(axis=0)
                s = np.linalg.svd((x / np.sqrt((x**2).sum())).T @ (y / np.sqrt((y**2).sum())), compute_uv=False).sum()
                hits += s >= level
            yield pd.DataFrame({"hits": [int(hits)]})

    hits = spark.range(n_iter).mapInPandas(run, "hits long").agg(F.sum("hits")).head()[0] or 0
    return (hits + 1) / (n_iter + 1)
