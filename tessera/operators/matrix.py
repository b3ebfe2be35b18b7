"""Labelled matrices in long form: one row an (``obs``, ``attr``, ``v``) cell.

Absent cells are zeros for the operators that say so; ``densify`` writes them
out.  NaN becomes NULL on entry (``clean``) and aggregates skip NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(x: DataFrame) -> DataFrame:
    """NaN cells as NULL, values as doubles."""
    v = F.col("v").cast("double")
    return x.withColumn("v", F.when(~F.isnan(v), v))


def transpose(x: DataFrame) -> DataFrame:
    return x.select(F.col("attr").alias("obs"), F.col("obs").alias("attr"), "v")


def by_obs(*order) -> "Window":
    w = Window.partitionBy("obs")
    return w.orderBy(*order) if order else w


def densify(x: DataFrame, fill: float = 0.0) -> DataFrame:
    """All cells of the observed axes; the attribute axis travels as one array."""
    attrs = x.agg(F.array_sort(F.collect_set("attr")).alias("attrs"))
    grid = x.select("obs").distinct().crossJoin(F.broadcast(attrs)).select("obs", F.explode("attrs").alias("attr"))
    return grid.join(x, ["obs", "attr"], "left").select("obs", "attr", F.coalesce("v", F.lit(fill)).alias("v"))


def where_all(df: DataFrame, conditions: dict, mode: str = "all") -> DataFrame:
    """Rows for which all (or any) of the predicates by column hold; a predicate maps a Column to a Column."""
    tests = [f(F.col(c)) for c, f in conditions.items()]
    return df.where(reduce(lambda a, b: a & b if mode == "all" else a | b, tests))


def _tolerance(tol, n: Column) -> Column:
    """A whole tolerance as it is; a share in (0, 1] of ``n``, rounded half to even."""
    return F.bround(n * F.lit(tol)) if isinstance(tol, float) and 0 < tol <= 1 else F.lit(1 if tol is None else tol)


def filter_compositional(x: DataFrame, depth=None, prevalence=None, richness=None, count=None, order=("depth", "prevalence", "richness", "count"), mode: str = "highpass", interval: str = "closed") -> DataFrame:
    """Sequential filters on observations (depth, richness) and attributes (prevalence, count), each on what the last left.

    Missing tolerances count as 1, but a missing depth is no filter.
    """
    op = {("highpass", "closed"): lambda a, b: a >= b, ("highpass", "open"): lambda a, b: a > b, ("lowpass", "closed"): lambda a, b: a <= b, ("lowpass", "open"): lambda a, b: a < b}[mode, interval]
    for step in order:
        if step == "depth" and depth is not None:
            keep = x.groupBy("obs").agg(F.sum("v").alias("s")).where(op(F.col("s"), F.lit(depth))).select("obs")
        elif step == "richness":
            keep = x.groupBy("obs").agg(F.count_if(F.col("v") > 0).alias("s")).where(op(F.col("s"), F.lit(1 if richness is None else richness))).select("obs")
        elif step == "prevalence":
            n = x.agg(F.count_distinct("obs").alias("n"))
            keep = x.groupBy("attr").agg(F.count_if(F.col("v") > 0).alias("s")).crossJoin(F.broadcast(n)).where(op(F.col("s"), _tolerance(prevalence, F.col("n")))).select("attr")
        elif step == "count":
            keep = x.groupBy("attr").agg(F.sum("v").alias("s")).where(op(F.col("s"), F.lit(1 if count is None else count))).select("attr")
        else:
            continue
        x = x.join(keep, keep.columns[0], "left_semi")
    return x


def collapse(df: DataFrame, value: str, key: str, into: str = "keys") -> DataFrame:
    """The set of keys of each value."""
    return df.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias(into))


def group_columns(df: DataFrame, value: str, by: str, groups: list | None = None) -> DataFrame:
    """Groups as columns of values, aligned by their order."""
    numbered = df.select(value, by, (F.row_number().over(Window.partitionBy(by).orderBy(value)) - 1).alias("row"))
    return numbered.groupBy("row").pivot(by, groups).agg(F.first(value))


def extend(df: DataFrame, keys: DataFrame, key: str, fill: dict) -> DataFrame:
    """Adds missing keys with fill values."""
    return df.join(keys.select(key).distinct(), key, "full").fillna(fill)


def drop_duplicates(df: DataFrame, key: str, *order: str, keep: str = "first") -> DataFrame:
    """The first or last row of each key in a stated order."""
    by = [F.col(o).asc() if keep == "first" else F.col(o).desc() for o in order]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("__n = 1").drop("__n")


def symmetric(x: DataFrame) -> DataFrame:
    """(X + transposed X) / 2 over cells of either."""
    both = x.unionByName(transpose(x))
    return both.groupBy("obs", "attr").agg((F.sum("v") / 2).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product over a's attributes and b's observations, as (obs, attr, v)."""
    right = b.select(F.col("obs").alias("attr"), F.col("attr").alias("__to"), F.col("v").alias("__w"))
    return a.join(right, "attr").groupBy("obs", F.col("__to").alias("attr")).agg(F.sum(F.col("v") * F.col("__w")).alias("v"))


def to_level(x: DataFrame, levels: DataFrame, level: str) -> DataFrame:
    """Cells summed by a level of their attributes; attributes without a level vanish."""
    named = levels.where(F.col(level).isNotNull()).select("attr", F.col(level).alias("__level"))
    return x.join(named, "attr").groupBy("obs", F.col("__level").alias("attr")).agg(F.sum("v").alias("v"))


def condensed(x: DataFrame) -> DataFrame:
    """The upper triangle of a square matrix as edges."""
    return x.where("obs < attr").select(F.col("obs").alias("node_a"), F.col("attr").alias("node_b"), F.col("v").alias("weight"))


def redundant(edges: DataFrame, diagonal: float | None = None) -> DataFrame:
    """Edges in both directions and, on request, a diagonal."""
    out = edges.select("node_a", "node_b", "weight").unionByName(edges.select(F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b"), "weight"))
    if diagonal is None:
        return out
    nodes = out.select("node_a").distinct()
    return out.unionByName(nodes.select("node_a", F.col("node_a").alias("node_b"), F.lit(float(diagonal)).alias("weight")))


def venn(sets: DataFrame, feature: str = "feature", name: str = "set_name") -> DataFrame:
    """Counts of features by the exact sets that they are in."""
    return sets.groupBy(feature).agg(F.concat_ws("&", F.array_sort(F.collect_set(name))).alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


def is_symmetric(x: DataFrame, tol: float = 1e-10) -> bool:
    """Whether the cells equal those of the transposed matrix."""
    both = x.join(transpose(x).withColumnRenamed("v", "w"), ["obs", "attr"], "full")
    return both.where(F.coalesce(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))), F.lit(0.0)) > tol).isEmpty()


def prepend_level(df: DataFrame, name: str, value) -> DataFrame:
    """A constant outer key."""
    return df.select(F.lit(value).alias(name), "*")
