"""Association networks on edges (``node_a`` < ``node_b``, ``weight``)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept
from .matrix import densify, redundant
from .pairs import bicor_units, cell_pairs, distance_of, ranked
from .stats import summary
from .subsamples import correlations


def connectivity(edges: DataFrame, loops: float | None = None) -> DataFrame:
    """Weighted degree of every node; ``loops`` adds a self-loop of that weight."""
    both = redundant(edges, loops)
    return both.groupBy(F.col("node_a").alias("node")).agg(F.sum("weight").alias("k"))


def intramodular(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Total, within and outside connectivity of nodes (``node``, ``cluster``), and within minus outside."""
    both = redundant(edges)
    a = clusters.select(F.col("node").alias("node_a"), F.col("cluster").alias("ca"))
    b = clusters.select(F.col("node").alias("node_b"), F.col("cluster").alias("cb"))
    rows = both.join(a, "node_a").join(b, "node_b")
    inside = F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0))
    return rows.groupBy(F.col("node_a").alias("node"), F.col("ca").alias("cluster")).agg(F.sum("weight").alias("k_total"), inside.alias("k_within"), (F.sum("weight") - inside).alias("k_out"), (2 * inside - F.sum("weight")).alias("k_diff"))


def metrics(k: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Density, centralisation and heterogeneity of connectivities ``k``."""
    n, s = F.count("k"), F.sum("k")
    return k.groupBy(*(by or [])).agg(
        F.try_divide(s, n * (n - 1)).alias("density"),
        F.try_divide(n * (F.max("k") - F.avg("k")), (n - 1) * (n - 2)).alias("centralization"),
        F.sqrt(F.greatest(F.lit(0.0), F.try_divide(n * F.sum(F.col("k") * F.col("k")), s * s) - 1)).alias("heterogeneity"),
    )


def scale_free(k: DataFrame, bins: int = 10, pseudocount: float = 1e-9, by: list[str] | None = None) -> DataFrame:
    """Log-log fits of the degree distribution over equal-width, right-closed bins: slope, R squared, signed fit and information criteria, and the fit with a truncation term."""
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(0)]))
    lo, hi, n = F.min("k").over(w), F.max("k").over(w), F.count("k").over(w)
    width = (F.col("hi") - F.col("lo")) / bins
    rows = k.withColumns({"lo": lo, "hi": hi, "n": n})
    rows = rows.withColumn("bin", F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.try_divide(F.col("k") - F.col("lo"), width)).cast("int"))))
    spread = k.groupBy(*by).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("k").alias("n")).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    got = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("c"), F.avg("k").alias("mk"))
    full = spread.join(got, [*by, "bin"], "left")
    middle = F.col("lo") + (F.col("bin") - 0.5) * width
    full = full.withColumns({"x": F.log10(F.when(F.coalesce(F.col("mk"), F.lit(0.0)) == 0, middle).otherwise(F.col("mk"))), "y": F.log10(F.coalesce(F.col("c") / F.col("n"), F.lit(0.0)) + pseudocount)})
    fit = full.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n"), F.regr_syy("y", "x").alias("syy"))
    rest = F.col("syy") * (1 - F.col("r2"))
    fit = fit.withColumns({"fit": -F.signum("slope") * F.col("r2"), "adj_r2": 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2), "loglik": -F.col("n") / 2 * (F.ln(2 * math.pi * rest / F.col("n")) + 1)})
    fit = fit.withColumns({"aic": 4 - 2 * F.col("loglik"), "bic": 2 * F.ln("n") - 2 * F.col("loglik")}).drop("n", "syy")
    return fit.join(_truncated(full, by), by) if by else fit.crossJoin(F.broadcast(_truncated(full, by)))


def _truncated(rows: DataFrame, by: list[str]) -> DataFrame:
    """R squared, plain and adjusted, of y on x and 10 ** x."""
    kinds = dict(rows.dtypes)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g.x.to_numpy(), g.y.to_numpy()
        m = np.column_stack((np.ones(len(x)), x, 10**x))
        r = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
        total = ((y - y.mean()) ** 2).sum()
        r2 = 1 - (r**2).sum() / total if total else np.nan
        return pd.DataFrame({**{c: [g[c].iloc[0]] for c in by}, "r2_truncated": [r2], "adj_r2_truncated": [1 - (1 - r2) * (len(x) - 1) / (len(x) - 3)]})

    return rows.groupBy(*by).applyInPandas(fit, ", ".join([*[f"{c} {kinds[c]}" for c in by], "r2_truncated double", "adj_r2_truncated double"]))


def soft_threshold(similarity: DataFrame, powers=(*range(1, 11), *range(12, 30, 2)), bins: int = 10) -> DataFrame:
    """Scale-free fit and mean connectivity for powers of a similarity (all at once)."""
    sums = redundant(similarity).groupBy(F.col("node_a").alias("node")).agg(*[F.sum(F.pow("weight", F.lit(p))).alias(f"k{n}") for n, p in enumerate(powers)])  # one pass over the edges
    k = sums.select("node", F.explode(F.array(*[F.struct(F.lit(p).alias("beta"), F.col(f"k{n}").alias("k")) for n, p in enumerate(powers)])).alias("s")).select("s.beta", "node", "s.k")
    mean = k.groupBy("beta").agg(F.avg("k").alias("mean_k"), F.max("k").alias("max_k"))
    return scale_free(k, bins, by=["beta"]).join(mean, "beta")


def topological_overlap(adjacency: DataFrame) -> DataFrame:
    """(shared neighbours + a) / (min degree + 1 - a) of all pairs of nodes."""
    both = redundant(adjacency)
    k = connectivity(adjacency)
    two = both.select("node_a", F.col("node_b").alias("mid"), F.col("weight").alias("w1")).join(both.select(F.col("node_a").alias("mid"), "node_b", F.col("weight").alias("w2")), "mid")
    shared = two.where("node_a < node_b").groupBy("node_a", "node_b").agg(F.sum(F.col("w1") * F.col("w2")).alias("l"))
    nodes = k.select("node")
    every = nodes.select(F.col("node").alias("node_a")).join(nodes.select(F.col("node").alias("node_b")), F.col("node_a") < F.col("node_b"))  # the result has all pairs
    a, b = (k.select(F.col("node").alias(f"node_{s}"), F.col("k").alias(f"k{s}")) for s in "ab")
    rows = every.join(shared, ["node_a", "node_b"], "left").join(adjacency, ["node_a", "node_b"], "left").join(a, "node_a").join(b, "node_b").fillna(0.0, ["l", "weight"])
    return rows.select("node_a", "node_b", ((F.col("l") + F.col("weight")) / (F.least("ka", "kb") + 1 - F.col("weight"))).alias("weight"))


def cooccurrence(clusters: DataFrame) -> DataFrame:
    """Share of iterations (``iter``, ``node``, ``cluster``) in which two nodes are in one cluster; pairs that never are, too."""
    n = clusters.agg(F.count_distinct("iter").alias("n"))
    a = clusters.select("iter", "cluster", F.col("node").alias("node_a"))
    b = clusters.select("iter", "cluster", F.col("node").alias("node_b"))
    together = a.join(b, ["iter", "cluster"]).where("node_a < node_b").groupBy("node_a", "node_b").agg(F.count(F.lit(1)).alias("c"))
    nodes = clusters.select("node").distinct()
    every = nodes.select(F.col("node").alias("node_a")).join(nodes.select(F.col("node").alias("node_b")), F.col("node_a") < F.col("node_b"))
    return every.join(together, ["node_a", "node_b"], "left").crossJoin(F.broadcast(n)).select("node_a", "node_b", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("weight"))


#: Statistics of an ensemble's draws.
STATISTICS = ("n", "sum", "mean", "sem", "var", "skew", "kurtosis", "normal_p", "median")


def subsample_size(n: int, share: float) -> int:
    """How many of n observations have a rank below the share."""
    return sum(k < share * (n - 1) for k in range(n)) if n > 1 else n


def _draws(chosen: DataFrame, metric) -> DataFrame:
    """``iter``, ``node_a``, ``node_b``, ``v`` of a metric from the cells of all subsamples (with ``iter`` and ``copy``)."""
    per = chosen.select("iter", F.struct("iter", "obs", "copy").alias("obs"), F.struct("iter", "attr").alias("attr"), "v")
    if metric == "spearman":
        per = ranked(per)
    elif metric == "bicor":
        per = bicor_units(per)
    a = per.select("obs", F.col("attr.attr").alias("node_a"), F.col("v").alias("x"))
    b = per.select("obs", F.col("attr.attr").alias("node_b"), F.col("v").alias("y"))
    rows = a.join(b, "obs").where("node_a < node_b").groupBy(F.col("obs.iter").alias("iter"), "node_a", "node_b")
    if callable(metric):
        value = metric(F.col("x"), F.col("y"))
    elif metric in ("pearson", "spearman"):
        value = F.corr("x", "y")
    else:
        value = F.sum(F.col("x") * F.col("y")) if metric == "bicor" else distance_of(metric)
    return rows.agg(value.alias("v"))


def ensemble(x: DataFrame, metric="pearson", n_iter: int = 100, share: float = 0.618, seed: int = 0, replacement: bool = False, transformation=None, statistics=STATISTICS, extra: dict | None = None, fill: float | None = None) -> DataFrame:
    """Statistics of every edge's association over seeded subsamples of the observations.

    ``metric`` is a correlation (pearson, spearman, bicor), any distance of
    ``pairs``, or a function of two columns that gives an aggregate.  Draws are
    without replacement unless asked for; more draws than there are different
    subsamples are an error.  ``transformation`` maps the cells first, ``extra``
    names aggregates (functions of the column of draws) beside the statistics.
    ``fill`` stands for absent cells.  Pearson's correlation without replacement
    goes by matrix products (``subsamples``).
    """
    products = metric == "pearson" and not replacement
    x = densify(x, fill) if fill is not None and (transformation or not products) else x
    cells = transformation(x) if transformation else x
    axis = cells.select("obs").distinct()
    n = axis.count()
    iters = F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1)))
    if replacement:
        size = max(1, int(n * share))
        numbered = axis.withColumn("at", F.row_number().over(Window.orderBy("obs")) - 1)  # a row an observation of one axis
        picks = x.sparkSession.range(n_iter * size).select((F.col("id") / size).cast("int").alias("iter"), F.col("id").alias("copy")).withColumn("at", F.pmod(F.xxhash64("iter", "copy", F.lit(seed)), F.lit(n)).cast("int"))
        chosen = picks.join(numbered, "at").select("obs", "iter", "copy")
    else:
        size = subsample_size(n, share)
        if not (0 < size < n and n_iter <= n) and math.comb(n, size) < n_iter:  # n at least of those between none and all
            raise ValueError(f"only {math.comb(n, size)} different subsamples")
        drawn = axis.withColumn("iter", iters).withColumn("u", F.xxhash64("obs", "iter", F.lit(seed)))
        rank = F.percent_rank().over(Window.partitionBy("iter").orderBy("u", "obs"))
        chosen = drawn.withColumn("r", rank).where(F.col("r") < share).select("obs", "iter", F.lit(0).cast("long").alias("copy"))
    if products:
        draws = correlations(cells, n_iter, size, n, seed, fill)
    else:
        draws = _draws(cells.join(chosen, "obs"), metric)
    more = {"median": F.median("v"), **{k: f(F.col("v")) for k, f in (extra or {}).items()}}
    wanted = [*statistics, *(extra or {})]
    out = summary(draws, ["node_a", "node_b"])
    beside = {k: c for k, c in more.items() if k in wanted}
    if beside:
        out = out.join(draws.groupBy("node_a", "node_b").agg(*[c.alias(k) for k, c in beside.items()]), ["node_a", "node_b"])
    return out.select("node_a", "node_b", *wanted)


def sample_perturbation(x: DataFrame, background: DataFrame, metric: str = "pearson") -> DataFrame:
    """For every observation outside the background: the correlation (pearson) or distance (euclidean, sqeuclidean, cityblock, chebyshev) with it added, minus that of the background alone.

    The background is summed once a pair; each observation's cells then update
    the sums of its pairs.
    """
    inside = cell_pairs(x.join(background.select("obs"), "obs", "left_semi")).groupBy("node_a", "node_b")
    outside = cell_pairs(x.join(background.select("obs"), "obs", "left_anti")).withColumnRenamed("obs", "sample")
    c = F.col
    if metric == "pearson":
        n = F.count(F.lit(1))
        base = inside.agg(n.cast("double").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * n).alias("xx"), (F.var_pop("y") * n).alias("yy"), (F.covar_pop("x", "y") * n).alias("xy"))
        rows, share = outside.join(base, ["node_a", "node_b"]), c("n") / (c("n") + 1)
        dx, dy = c("x") - c("mx"), c("y") - c("my")
        ratio = lambda xy, xx, yy: F.try_divide(xy, F.sqrt(xx * yy))
        new, old = ratio(c("xy") + dx * dy * share, c("xx") + dx * dx * share, c("yy") + dy * dy * share), ratio(c("xy"), c("xx"), c("yy"))
    else:
        gap, d = F.abs(c("x") - c("y")), c("w0")
        new = {"euclidean": F.sqrt(d * d + gap * gap), "sqeuclidean": d + gap * gap, "cityblock": d + gap, "chebyshev": F.greatest(d, gap)}[metric]
        rows, old = outside.join(inside.agg(distance_of(metric).alias("w0")), ["node_a", "node_b"]), d
    return rows.select("sample", "node_a", "node_b", (new - old).alias("weight"))


def differential(reference: DataFrame, treatment: DataFrame) -> DataFrame:
    """Treatment minus reference of edges that both networks have."""
    return treatment.withColumnRenamed("weight", "t").join(reference.withColumnRenamed("weight", "r"), ["node_a", "node_b"]).select("node_a", "node_b", (F.col("t") - F.col("r")).alias("weight"))


def communities(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Label propagation: each node takes the label with most weight among neighbours (the least on ties) until none changes; an error if that takes more than ``rounds``."""
    both = redundant(edges).cache()
    labels = both.select(F.col("node_a").alias("node")).distinct().withColumn("label", F.col("node").cast("string"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "node_b"), "node_b").groupBy(F.col("node_a").alias("node"), "label").agg(F.sum("weight").alias("w"))
        new = kept(votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("o"), "label")).alias("s")).select("node", F.col("s.label").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            both.unpersist()
            return labels
    both.unpersist()
    raise ValueError(f"labels still change after {rounds} rounds")


def axis_connections(edges: DataFrame, axes: DataFrame) -> DataFrame:
    """Weight of every node to every axis (``node``, ``axis``)."""
    both = redundant(edges)
    return both.join(axes.select(F.col("node").alias("node_b"), "axis"), "node_b").groupBy(F.col("node_a").alias("node"), "axis").agg(F.sum("weight").alias("weight"))


def compare_axes(a: DataFrame, b: DataFrame, axes: DataFrame) -> DataFrame:
    """Rank-sum p of each node's weights to each axis in two networks."""
    from .pairs import _mannwhitney

    def weights(e: DataFrame, name: str) -> DataFrame:
        return redundant(e).join(axes.select(F.col("node").alias("node_b"), "axis"), "node_b").groupBy(F.col("node_a").alias("node"), "axis").agg(F.array_sort(F.collect_list("weight")).alias(name))

    @F.pandas_udf("double")
    def test(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([_mannwhitney(np.asarray(u, float), np.asarray(v, float)) for u, v in zip(p, q, strict=True)], dtype="float64")

    return weights(a, "wa").join(weights(b, "wb"), ["node", "axis"]).select("node", "axis", test("wa", "wb").alias("p_value"))


def edge_struct(a, b, weight, directed=None):
    """An edge as a struct: ends, absolute weight, sign, and direction (NULL for a self-loop); undirected ends are ordered."""
    swap = (a > b) & F.coalesce(~F.lit(directed) if directed is not None else F.lit(True), F.lit(True))
    way = F.when(a == b, F.lit(None).cast("boolean")).otherwise(F.lit(bool(directed)))
    return F.struct(F.when(swap, b).otherwise(a).alias("node_a"), F.when(swap, a).otherwise(b).alias("node_b"), F.abs(weight).alias("weight"), F.signum(weight).cast("int").alias("sign"), way.alias("directed"))


def partition(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, seed: int = 0, resolution: float = 1.0) -> np.ndarray:
    """Communities of nodes 0 .. n-1 by modularity: seeded greedy moves until none helps, then the same on the graph of communities, until that has none to move."""
    keep = a != b
    near: list[dict] = [{} for _ in range(n)]
    loop = np.zeros(n)
    for i, j, v in zip(a[keep].tolist(), b[keep].tolist(), w[keep].tolist(), strict=True):
        near[i][j] = near[i].get(j, 0.0) + v
        near[j][i] = near[j].get(i, 0.0) + v
    np.add.at(loop, a[~keep], 2 * w[~keep])
    rng, label = np.random.RandomState(seed), np.arange(n)
    while True:
        size = len(near)
        k = np.array([sum(m.values()) for m in near]) + loop
        m2, own, total = float(k.sum()), list(range(size)), k.tolist()
        if m2 <= 0:
            return label
        moved = True
        while moved:
            moved = False
            for i in rng.permutation(size).tolist():
                links: dict = {}
                for j, v in near[i].items():
                    links[own[j]] = links.get(own[j], 0.0) + v
                old = own[i]
                total[old] -= k[i]
                best, top = old, links.get(old, 0.0) - resolution * k[i] * total[old] / m2
                for c in sorted(links):
                    gain = links[c] - resolution * k[i] * total[c] / m2
                    if gain > top + 1e-12 * m2:
                        best, top = c, gain
                total[best] += k[i]
                own[i], moved = best, moved or best != old
        names = {c: x for x, c in enumerate(dict.fromkeys(own))}
        if len(names) == size:
            return label
        label = np.array([names[own[c]] for c in label])
        merged: list[dict] = [{} for _ in names]
        inside = np.zeros(len(names))
        for i in range(size):
            p = names[own[i]]
            inside[p] += loop[i]
            for j, v in near[i].items():
                q = names[own[j]]
                if p == q:
                    inside[p] += v
                else:
                    merged[p][q] = merged[p].get(q, 0.0) + v
        near, loop = merged, inside


def community_detection(edges: DataFrame, n_iter: int = 10, seed: int = 0, limit: int = 5_000_000, resolution: float = 1.0) -> DataFrame:
    """Partitions of a graph of at most ``limit`` edges for seeds ``seed`` .. ``seed + n_iter - 1``: ``iter``, ``node``, ``cluster``; see ``louvain`` for larger ones."""
    small = edges.select("node_a", "node_b", "weight").limit(limit + 1).toPandas()
    if len(small) > limit:
        raise ValueError("too many edges; use louvain()")
    nodes = sorted(set(small.node_a) | set(small.node_b))
    at, kind = {v: i for i, v in enumerate(nodes)}, dict(edges.dtypes)["node_a"]
    shared = edges.sparkSession.sparkContext.broadcast((small.node_a.map(at).to_numpy(int), small.node_b.map(at).to_numpy(int), small.weight.to_numpy(float), nodes))

    def run(frames):
        a, b, w, nodes = shared.value
        for f in frames:
            for i in f.iter:
                yield pd.DataFrame({"iter": int(i), "node": nodes, "cluster": partition(a, b, w, len(nodes), seed + int(i), resolution)})

    return edges.sparkSession.range(n_iter).withColumnRenamed("id", "iter").repartition(n_iter).mapInPandas(run, f"iter long, node {kind}, cluster long")


def modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``modularity`` of a partition (``node``, ``cluster``) of an undirected graph without repeated edges."""
    a, b = clusters.select(F.col("node").alias("node_a"), F.col("cluster").alias("ca")), clusters.select(F.col("node").alias("node_b"), F.col("cluster").alias("cb"))
    rows = edges.join(a, "node_a").join(b, "node_b")
    inside = rows.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("i"))
    ends = rows.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("d"))
    m = F.sum("d") / 2
    return ends.join(inside, "c", "left").agg((F.coalesce(F.sum("i"), F.lit(0.0)) / m - resolution * F.sum(F.col("d") * F.col("d")) / (4 * m * m)).alias("modularity"))


def louvain(edges: DataFrame, seed: int = 0, resolution: float = 1.0, driver_edges: int = 200_000, patience: int = 4) -> DataFrame:
    """``node``, ``cluster`` by modularity on a graph of any size.

    In each round the half of the nodes that a hash names may move to the
    neighbouring community of greatest gain; rounds end when ``patience`` in a
    row do not raise the modularity, and the best partition stays.  Then
    communities become nodes.  A graph of at most ``driver_edges`` edges (after
    any level) is finished by ``partition``.
    """
    spark, kind = edges.sparkSession, dict(edges.dtypes)["node_a"]
    ends = F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")
    graph = kept(edges.where("weight > 0").groupBy(*ends).agg(F.sum("weight").alias("w")))
    label = kept(graph.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cluster", F.col("node")))
    level = 0
    while graph.count() > driver_edges:
        both = kept(graph.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other"), "w").unionByName(graph.where("a <> b").select(F.col("b").alias("node"), F.col("a").alias("other"), "w")))
        k = kept(graph.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k")))
        m2 = float(k.agg(F.sum("k")).head()[0])
        own = best = kept(k.select("node", F.col("node").alias("c")))
        links_of = graph.select(F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.col("w").alias("weight"))
        top, stale, turn = modularity(links_of, own.withColumnRenamed("c", "cluster"), resolution).head()[0], 0, 0
        while stale < patience:
            total = own.join(k, "node").groupBy("c").agg(F.sum("k").alias("t"))
            links = both.join(own.select(F.col("node").alias("other"), F.col("c").alias("to")), "other").groupBy("node", "to").agg(F.sum("w").alias("l"))
            stay = own.select("node", F.col("c").alias("to"), F.lit(0.0).alias("l"))
            tried = links.unionByName(stay).groupBy("node", "to").agg(F.sum("l").alias("l")).join(own, "node").join(k, "node").join(total.withColumnRenamed("c", "to"), "to")
            gain = F.col("l") - resolution * F.col("k") * (F.col("t") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / m2
            pick = tried.groupBy("node").agg(F.first("c").alias("c"), F.max_by("to", F.struct(gain.alias("g"), (F.col("to") == F.col("c")).alias("s"), "to")).alias("to"))
            free = F.pmod(F.xxhash64("node", F.lit(seed), F.lit(level), F.lit(turn)), F.lit(2)) == 0
            own = kept(pick.select("node", F.when(free, F.col("to")).otherwise(F.col("c")).alias("c")))
            now, turn = modularity(links_of, own.withColumnRenamed("c", "cluster"), resolution).head()[0], turn + 1
            if now > top + 1e-9:
                best, top, stale = own, now, 0
            else:
                stale += 1
        before = k.count()
        label = kept(label.join(best.select(F.col("node").alias("cluster"), "c"), "cluster").select("node", F.col("c").alias("cluster")))
        ca, cb = best.select(F.col("node").alias("a"), F.col("c").alias("ca")), best.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        graph = kept(graph.join(ca, "a").join(cb, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
        level += 1
        if best.select("c").distinct().count() == before:
            return label
    small = graph.toPandas()  # at most driver_edges rows
    nodes = sorted(set(small.a) | set(small.b))
    at = {v: i for i, v in enumerate(nodes)}
    found = partition(small.a.map(at).to_numpy(int), small.b.map(at).to_numpy(int), small.w.to_numpy(float), len(nodes), seed, resolution)
    first: dict = {}
    for v, c in zip(nodes, found.tolist(), strict=True):
        first.setdefault(c, v)
    names = spark.createDataFrame([(v, first[c]) for v, c in zip(nodes, found.tolist(), strict=True)], f"cluster {kind}, c {kind}")
    return label.join(F.broadcast(names), "cluster").select("node", F.col("c").alias("cluster"))
