"""Tests and corrections.  Statistics are aggregates and windows; only tails of distributions run in Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_sf2
from ..storage import kept


def welch(x: DataFrame, group: str, a, b) -> DataFrame:
    """Welch's t of each attribute between two groups: statistic, degrees of freedom and two-sided p."""
    side = lambda g, s: [f(F.when(F.col(group) == g, F.col("v"))).alias(n + s) for n, f in (("m", F.avg), ("s", F.var_samp), ("n", F.count))]
    rows = x.groupBy("attr").agg(*side(a, "a"), *side(b, "b"))
    ua, ub = F.col("sa") / F.col("na"), F.col("sb") / F.col("nb")
    rows = rows.select("attr", F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(ua + ub)).alias("t"), F.try_divide(F.pow(ua + ub, 2), ua * ua / (F.col("na") - 1) + ub * ub / (F.col("nb") - 1)).alias("df"))

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_sf2(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df, strict=True)], dtype="float64")

    return rows.withColumn("p_value", tail("t", "df"))


def _hommel(p: np.ndarray) -> np.ndarray:
    """Hommel's adjusted p-values in n log n.

    A set of the i largest p-values is rejected from the level s_i on, the least
    i * p / j of its j-th member, which is a tangent to the lower hull of the
    sorted values; a p-value is rejected at a level no less than it times the
    number of the largest set that is not.
    """
    n, order = len(p), np.argsort(p, kind="stable")
    y = p[order].tolist()
    hull: list[int] = []  # right to left
    level = np.empty(n + 2)
    level[0] = np.inf
    for i in range(1, n + 1):
        x = n - i  # the new point is at x + 1, the tangent starts at (x, 0)
        while len(hull) > 1 and (y[hull[-2]] - y[x]) * (hull[-1] - x) <= (y[hull[-1]] - y[x]) * (hull[-2] - x):
            hull.pop()
        hull.append(x)
        lo, hi = 0, len(hull) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if y[hull[mid]] * (hull[mid + 1] - x + 1) <= y[hull[mid + 1]] * (hull[mid] - x + 1):
                hi = mid
            else:
                lo = mid + 1
        level[i] = i * y[hull[lo]] / (hull[lo] - x + 1)
    level[n + 1] = 0.0
    top = np.maximum.accumulate(level[::-1])[::-1]  # of sets at least as large
    v = np.asarray(y)
    lo, hi = np.zeros(n, np.int64), np.full(n, n, np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        enough = mid * v >= top[mid + 1]
        lo, hi = np.where(enough, lo, np.minimum(mid + 1, hi)), np.where(enough, mid, hi)
    best = np.minimum(np.maximum(lo * v, top[np.minimum(lo + 1, n + 1)]), top[lo])
    out = np.empty(n)
    out[order] = np.maximum(best, v)
    return np.minimum(out, 1)


def _two_stage(p: np.ndarray, alpha: float, bky: bool) -> np.ndarray:
    n = len(p)
    order = np.argsort(p)
    bh = np.minimum.accumulate((p[order] * n / np.arange(1, n + 1))[::-1])[::-1]
    level = alpha / (1 + alpha) if bky else alpha
    rejected = int((bh <= level).sum())
    n0 = n - rejected
    factor = (n0 / n if 0 < rejected < n else 1.0) * (1 + alpha if bky else 1)
    out = np.empty(n)
    out[order] = np.minimum(bh * factor, 1)
    return out


def p_adjust(df: DataFrame, p: str = "p_value", method: str = "fdr_bh", into: str = "q_value", by: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Adjusted p-values over all rows or inside each ``by``; NULLs neither count nor change.

    Over all rows only ``hommel`` needs them in one task; the others rank them by
    ranges of p (``p_adjust_many``).
    """
    method = {"fdr": "fdr_bh", "bh": "fdr_bh", "by": "fdr_by"}.get(method, method)
    if by is None and method != "hommel":
        return p_adjust_many(df, p, method, into, alpha)
    if method in ("hommel", "fdr_tsbh", "fdr_tsbky"):
        kind = df.schema.fields
        change = _hommel if method == "hommel" else lambda v: _two_stage(v, alpha, method == "fdr_tsbky")

        def group(g: pd.DataFrame) -> pd.DataFrame:
            ok = g[p].notna()
            out = pd.Series(np.nan, index=g.index)
            out[ok] = change(g.loc[ok, p].to_numpy(float)) if ok.any() else []
            return g.assign(**{into: out})

        from pyspark.sql.types import DoubleType, StructField, StructType

        return (df.groupBy(by) if by else df.groupBy()).applyInPandas(group, StructType([*kind, StructField(into, DoubleType())]))
    part = Window.partitionBy(by, F.col(p).isNull())
    down = part.orderBy(F.desc(p), F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    up = part.orderBy(p, "__r").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"__m": F.count(F.col(p)).over(part), "__r": F.row_number().over(part.orderBy(p))})
    if method == "fdr_by":  # one sum of a harmonic series a size, not a row
        sizes = rows.select("__m").distinct().withColumn("__c", F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest("__m", F.lit(1).cast("long"))), F.lit(0.0), lambda s, k: s + 1 / k))
        rows = rows.join(sizes, "__m")
    rows = rows.withColumn("__v", _steps(p, F.col("__c") if method == "fdr_by" else F.lit(1.0))[method])
    out = {"holm": F.max("__v").over(up), "holm-sidak": F.max("__v").over(up), "simes-hochberg": F.min("__v").over(down), "fdr_bh": F.min("__v").over(down), "fdr_by": F.min("__v").over(down)}.get(method, F.col("__v"))
    return rows.withColumn(into, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), out))).select(*df.columns, into)


def _steps(p: str, harmonic: Column) -> dict[str, Column]:
    """Values of ranked p-values (columns ``__r`` of ``__m``) by method, before running extremes."""
    q, m, left = F.col(p), F.col("__m"), F.col("__m") - F.col("__r") + 1
    return {
        "bonferroni": q * m,
        "sidak": 1 - F.pow(1 - q, m),
        "holm": q * left,
        "holm-sidak": 1 - F.pow(1 - q, left),
        "simes-hochberg": q * left,
        "fdr_bh": q * m / F.col("__r"),
        "fdr_by": q * m / F.col("__r") * harmonic,
    }


def p_adjust_many(df: DataFrame, p: str = "p_value", method: str = "fdr_bh", into: str = "q_value", alpha: float = 0.05) -> DataFrame:
    """``p_adjust`` over all rows (all methods but ``hommel``) without a window over all of them.

    Rows are range-partitioned by p (equal ones by a hash of the row) and kept;
    ranks and running extremes are windows inside partitions, carried over by a
    row a partition.  Columns must not be maps.
    """
    method = {"fdr": "fdr_bh", "bh": "fdr_bh", "by": "fdr_by"}.get(method, method)
    if method in ("fdr_tsbh", "fdr_tsbky"):
        bky = method == "fdr_tsbky"
        first = kept(p_adjust_many(df, p, "fdr_bh", "__bh"))
        n, rejected = first.agg(F.count("__bh"), F.count_if(F.col("__bh") <= (alpha / (1 + alpha) if bky else alpha))).head()
        factor = ((n - rejected) / n if 0 < rejected < n else 1.0) * (1 + alpha if bky else 1)
        return first.withColumn(into, F.when(F.col("__bh").isNotNull(), F.least(F.lit(1.0), F.col("__bh") * F.lit(float(factor))))).drop("__bh")
    order = [F.col(p), F.xxhash64(*df.columns)]
    placed = kept(df.where(F.col(p).isNotNull()).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r["__part"], r.n) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    m = sum(n for _, n in sizes)
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    spark = df.sparkSession
    rows = placed.join(F.broadcast(spark.createDataFrame([(k, b) for (k, _), b in zip(sizes, before, strict=False)], "__part int, __before long")), "__part")
    rows = rows.withColumns({"__m": F.lit(m).cast("long"), "__r": F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")})
    harmonic = float(np.sum(1 / np.arange(1, m + 1))) if m <= 10**7 else float(np.log(m) + np.euler_gamma + 1 / (2 * m))
    rows = rows.withColumn("__v", _steps(p, F.lit(harmonic))[method])
    if method in ("bonferroni", "sidak"):
        best = F.col("__v")
    else:
        up = method in ("holm", "holm-sidak")
        ends = dict(tuple(r) for r in rows.groupBy("__part").agg((F.max if up else F.min)("__v")).collect())
        carried, edge = [], None
        for k, _ in sizes if up else reversed(sizes):
            carried.append((k, edge))
            edge = ends[k] if edge is None else (max if up else min)(edge, ends[k])
        inside = Window.partitionBy("__part").orderBy("__r" if up else F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.join(F.broadcast(spark.createDataFrame(carried, "__part int, __e double")), "__part")
        best = F.greatest(F.max("__v").over(inside), "__e") if up else F.least(F.min("__v").over(inside), "__e")
    out = rows.withColumn(into, F.least(F.lit(1.0), best)).select(*df.columns, into)
    return out.unionByName(df.where(F.col(p).isNull()).withColumn(into, F.lit(None).cast("double")))


def symbols(p: Column, other: str = "ns") -> Column:
    """Stars of significance; the empty string for NULL."""
    return F.when(p <= 0.0001, "****").when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").when(p > 0.05, other).otherwise("")


def volcano(df: DataFrame, effect: str, p: str, tol_effect: float = 1.0, tol_test: float = 0.05) -> DataFrame:
    """-log2 p and whether effect and test are both significant."""
    return df.withColumns({"y": -F.log2(p), "significant": (F.abs(effect) >= tol_effect) & (F.col(p) < tol_test)})


def summary(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """n, sum, mean, standard error (ddof 1), variance (ddof 0), skewness, excess kurtosis and the normality test of each group."""
    from ..functions.special import normaltest

    rows = df.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"), F.var_pop(v).alias("var"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"))

    @F.pandas_udf("double")
    def tail(s: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([normaltest(a, b, int(c))[1] if c >= 8 and pd.notna(a) else None for a, b, c in zip(s, k, n, strict=True)], dtype="float64")

    return rows.withColumn("normal_p", tail("skew", "kurtosis", "n"))
