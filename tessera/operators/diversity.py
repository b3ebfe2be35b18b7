"""Diversity of observations and of pairs, rollups, taxonomy votes and set enrichment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import hypergeom_sf
from .matrix import by_obs, to_level
from .stats import p_adjust


def depth_richness(x: DataFrame) -> DataFrame:
    return x.groupBy("obs").agg(F.sum("v").alias("depth"), F.count_if(F.col("v") > 0).alias("richness"))


def prevalence(x: DataFrame, interval: str = "closed", scale: bool = False) -> DataFrame:
    """For every number of observations, the attributes found in as many or more (``open``: more)."""
    own = x.groupBy("attr").agg(F.count_if(F.col("v") > 0).alias("k"))
    n = x.agg(F.count_distinct("obs").alias("n"))
    by_k = own.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    steps = n.select("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("tol"))
    at = F.col("tol") if interval == "closed" else F.col("tol") + 1
    joined = steps.join(by_k, F.col("k") >= at, "left").groupBy("n", "tol").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_attributes"))
    return joined.select((F.col("tol") / F.col("n") if scale else F.col("tol")).alias("tolerance"), "n_attributes")


def alpha_diversity(x: DataFrame, base: float = 2.0, metric=None) -> DataFrame:
    """Entropy, richness, singletons and Gini index (by the Lorenz curve's trapezoids over non-zero cells) of each observation.

    With ``metric``, a function of the columns of values and shares that gives an
    aggregate, only its ``value``.
    """
    total = F.sum("v").over(by_obs())
    if metric is not None:
        return x.where("v > 0").withColumn("p", F.col("v") / total).groupBy("obs").agg(metric(F.col("v"), F.col("p")).alias("value"))
    rows = x.where("v > 0").withColumns({"p": F.col("v") / total, "i": F.row_number().over(by_obs("v", "attr"))})
    n, weighted = F.count(F.lit(1)), F.sum(F.col("i") * F.col("p"))
    return rows.groupBy("obs").agg(
        (-F.sum(F.col("p") * F.ln("p")) / F.ln(F.lit(base))).alias("entropy"),
        n.alias("richness"),
        F.count_if(F.col("v") == 1).alias("singletons"),
        (2 * weighted / n - (n + 1) / n).alias("gini"),
    )


def alpha_by_level(x: DataFrame, levels: DataFrame, names: list[str]) -> DataFrame:
    """``alpha_diversity`` after rolling up to each level, and of the attributes themselves."""
    out = alpha_diversity(x).withColumn("level", F.lit("attr"))
    for name in names:
        out = out.unionByName(alpha_diversity(to_level(x, levels, name)).withColumn("level", F.lit(name)))
    return out


def beta_diversity(edges: DataFrame, y: DataFrame) -> DataFrame:
    """Distances inside each class, and between it and others (each such pair once for either class)."""
    a, b = (y.select(F.col("obs").alias(f"node_{s}"), F.col("class").alias(f"class_{s}")) for s in "ab")
    rows = edges.join(a, "node_a").join(b, "node_b")
    kind = F.when(F.col("class_a") == F.col("class_b"), "Intra").otherwise("Inter")
    owners = F.when(F.col("class_a") == F.col("class_b"), F.array("class_a")).otherwise(F.array("class_a", "class_b"))
    return rows.select("node_a", "node_b", kind.alias("kind"), F.explode(owners).alias("class"), "weight")


def kullback_leibler(p: DataFrame, q: DataFrame, base: float = 2.0) -> DataFrame:
    """Relative entropy of distributions (``attr``, ``v``); infinite where p has what q lacks."""
    n = lambda d, name: d.where("v > 0").select("attr", (F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(0)))).alias(name))
    both = n(p, "p").join(n(q, "q"), "attr", "left")
    term = F.when(F.col("q").isNull(), F.lit(float("inf"))).otherwise(F.col("p") * F.ln(F.col("p") / F.col("q")) / F.ln(F.lit(base)))
    return both.agg(F.sum(term).alias("kl"))


def infer_taxonomy(hits: DataFrame, domains: DataFrame | None = None, include: list | None = None) -> DataFrame:
    """Votes of hits (``grp``, ``taxon``, ``identity``): winners (an array, ties included), score, hits and weights of each group.

    With ``domains`` (``seq``, ``domain``) only hits whose ``seq`` has one of the
    included domains (any, if none are named) vote.
    """
    if domains is not None:
        known = domains if include is None else domains.where(F.col("domain").isin(list(include)))
        hits = hits.join(known.select("seq"), "seq", "left_semi")
    high = hits.agg(F.max("identity").alias("top"))
    votes = hits.groupBy("grp", "taxon").agg(F.sum("identity").alias("w"), F.count(F.lit(1)).alias("hits")).crossJoin(F.broadcast(high))
    votes = votes.withColumn("w", F.when(F.col("top") > 1, F.col("w") / 100).otherwise(F.col("w"))).drop("top")
    share = F.col("w") / F.sum("w").over(Window.partitionBy("grp"))
    ranked = votes.withColumns({"score": share, "r": F.rank().over(Window.partitionBy("grp").orderBy(F.desc("w")))})
    return ranked.groupBy("grp").agg(
        F.array_sort(F.collect_list(F.when(F.col("r") == 1, F.col("taxon")))).alias("taxa"),
        F.max("score").alias("score"),
        F.sum("hits").alias("hits"),
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "taxon", "score"))).alias("weights"),
    )


def enrichment(query: DataFrame, sets: DataFrame, tol: float = 0.05, fdr: str = "fdr_bh", strict: bool = False) -> DataFrame:
    """Hypergeometric over-representation of query features in sets (``set_name``, ``feature``).

    The query counts whole, also outside the sets' universe, unless ``strict``.
    """
    sets, query = sets.distinct(), query.select("feature").distinct()
    if strict:
        query = query.join(sets, "feature", "left_semi")
    m = sets.agg(F.count_distinct("feature").alias("universe"))
    n = query.agg(F.count(F.lit(1)).alias("query_size"))
    hit = query.withColumn("__q", F.lit(1))
    rows = sets.join(hit, "feature", "left").groupBy("set_name").agg(F.count(F.lit(1)).alias("set_size"), F.count("__q").alias("overlap"))
    rows = rows.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(n))

    @F.pandas_udf("double")
    def tail(k: pd.Series, big: pd.Series, good: pd.Series, draws: pd.Series) -> pd.Series:
        return pd.Series([hypergeom_sf(a - 1, b, c, d) for a, b, c, d in zip(k, big, good, draws, strict=True)])

    out = rows.withColumn("p_value", tail("overlap", "universe", "set_size", "query_size"))
    return p_adjust(out, "p_value", fdr, "q_value").withColumn("enriched", F.col("q_value") < tol)


def group_centroids(points: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return points.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])


def ellipses(points: DataFrame, by: str, x: str = "x", y: str = "y", n_std: float = 3.0) -> DataFrame:
    """Centre, axes and angle (degrees) of each group's covariance ellipse."""
    s = points.groupBy(by).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("a"), F.covar_samp(x, y).alias("b"), F.var_samp(y).alias("c"))
    half, gap = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.pow("b", 2))
    theta = F.degrees(F.atan2(half + gap - F.col("a"), F.col("b")))
    side = lambda v: 2 * n_std * F.sqrt(F.greatest(v, F.lit(0.0)))
    return s.select(by, "cx", "cy", side(half + gap).alias("width"), side(half - gap).alias("height"), theta.alias("theta"))


def compositional_table(x: DataFrame) -> DataFrame:
    """log10 depth, richness and entropy of observations that are not all zero."""
    return depth_richness(x).where("depth > 0").select("obs", F.log10("depth").alias("log_depth")).join(alpha_diversity(x).select("obs", "richness", "entropy"), "obs")
