"""Normalisation of observations.  Cells are (``obs``, ``attr``, ``v``); each is a window over one observation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrix import by_obs, densify, transpose


def tss(x: DataFrame) -> DataFrame:
    """Shares of the observation's total; NULL for an all-zero one."""
    return x.withColumn("v", F.try_divide("v", F.sum("v").over(by_obs())))


def center(x: DataFrame) -> DataFrame:
    return x.withColumn("v", F.col("v") - F.avg("v").over(by_obs()))


def zscore(x: DataFrame, ddof: int = 0) -> DataFrame:
    """Standard scores: ddof 0 for matrices, 1 for single vectors."""
    spread = F.stddev_pop("v") if ddof == 0 else F.stddev_samp("v")
    return x.withColumn("v", F.try_divide(F.col("v") - F.avg("v").over(by_obs()), spread.over(by_obs())))


def minmax(x: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Scales each observation to a range; a constant one becomes its lower end."""
    low, high = F.min("v").over(by_obs()), F.max("v").over(by_obs())
    return x.withColumn("v", F.lit(lo) + F.coalesce(F.try_divide(F.col("v") - low, high - low), F.lit(0.0)) * (hi - lo))


def quantile(x: DataFrame) -> DataFrame:
    """Values by their rank's mean over observations; ties take the lowest rank's."""
    ranked = x.withColumns({"__first": F.row_number().over(by_obs("v", "attr")), "__low": F.rank().over(by_obs("v"))})
    means = ranked.groupBy(F.col("__first").alias("__low")).agg(F.avg("v").alias("__mean"))
    return ranked.join(means, "__low").select("obs", "attr", F.col("__mean").alias("v"))


def css(x: DataFrame, q: float = 0.5, scale: float = 1000.0, fill: float = 0.0) -> DataFrame:
    """Cumulative-sum scaling by the cells up to the quantile of non-zero ones."""
    some = F.when(F.col("v") != 0, F.col("v"))
    cut = x.withColumn("__q", F.percentile(some, q).over(by_obs()))
    factor = F.sum(F.when(some <= F.col("__q"), some)).over(by_obs()) / scale
    return cut.withColumn("__f", factor).select("obs", "attr", F.coalesce(F.try_divide(some, "__f"), F.lit(fill)).alias("v"))


def with_length(x: DataFrame, length: DataFrame) -> DataFrame:
    """Cells with their attribute's length; an attribute without one is an error."""
    joined = x.join(length.select("attr", F.col("length").cast("double").alias("length")), "attr", "left")
    known = F.when(F.col("length").isNull(), F.raise_error(F.concat(F.lit("no length of "), F.col("attr").cast("string"))).cast("double")).otherwise(F.col("length"))
    return joined.withColumn("length", known)


def rpk(x: DataFrame, length: DataFrame) -> DataFrame:
    return with_length(x, length).select("obs", "attr", F.try_divide("v", "length").alias("v"))


def fpkm(x: DataFrame, length: DataFrame) -> DataFrame:
    total = F.sum("v").over(by_obs())
    return with_length(x, length).select("obs", "attr", F.try_divide(F.col("v") * 1e9, total * F.col("length")).alias("v"))


def tpm(x: DataFrame, length: DataFrame) -> DataFrame:
    return rpk(x, length).withColumn("v", F.try_divide(F.col("v") * 1e6, F.sum("v").over(by_obs())))


def replace_zeros(x: DataFrame) -> DataFrame:
    """Cells with 1 / m^2 added if any cell is zero, for m attributes (zeros must be present: see ``densify``); negative cells are an error."""
    n = x.agg(F.count_distinct("attr").alias("m"), F.count_if(F.col("v") == 0).alias("zeros"), F.count_if(F.col("v") < 0).alias("low"))
    rows = x.crossJoin(F.broadcast(n))
    shift = F.when(F.col("low") > 0, F.raise_error(F.lit("cells must not be negative")).cast("double")).when(F.col("zeros") > 0, 1 / (F.col("m") * F.col("m"))).otherwise(0.0)
    return rows.select("obs", "attr", (F.col("v") + shift).alias("v"))


def transform(x: DataFrame, method: str = "clr", axis: int = 1) -> DataFrame:
    """``tss`` or ``clr`` of a dense matrix along an axis, zeros replaced before logarithms."""
    x = transpose(x) if axis == 0 else x
    out = clr(replace_zeros(x)) if method == "clr" else tss(x)
    return transpose(out) if axis == 0 else out


def clr(x: DataFrame) -> DataFrame:
    """Centred log-ratios of the positive cells."""
    return x.where("v > 0").withColumn("v", F.ln("v")).withColumn("v", F.col("v") - F.avg("v").over(by_obs()))


def xlr(x: DataFrame, reference: DataFrame | None = None, centroid: str = "mean") -> DataFrame:
    """Log-ratios to the mean, median or harmonic centre of the reference attributes (all by default)."""
    logs = x.where("v > 0").withColumn("l", F.ln("v"))
    logs = logs.withColumn("r", F.lit(True)) if reference is None else logs.join(reference.select("attr", F.lit(True).alias("r")), "attr", "left")
    inside = F.when(F.col("r"), F.col("l"))
    w = by_obs()
    middle = {"mean": F.avg(inside).over(w), "median": F.median(inside).over(w), "hmean": F.ln(F.count(inside).over(w) / F.sum(F.when(F.col("r"), 1 / F.col("v"))).over(w))}[centroid]
    return logs.withColumn("c", middle).select("obs", "attr", (F.col("l") - F.col("c")).alias("v"))


def iqlr(x: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Log-ratios to attributes whose CLR variance is strictly between two quantiles."""
    variance = clr(x).groupBy("attr").agg(F.var_samp("v").alias("s"))
    axis = variance.agg(F.percentile("s", low).alias("lo"), F.percentile("s", high).alias("hi"), F.collect_list(F.struct("attr", "s")).alias("every"))  # bounds and variances of one pass: sums of another may differ in the last bit
    return xlr(x, axis.select("lo", "hi", F.explode("every").alias("e")).where("e.s > lo and e.s < hi").select("e.attr"))


def ilr(x: DataFrame) -> DataFrame:
    """Isometric log-ratios in the default basis: attribute i+1 against the first i, in attribute order; zeros are an error."""
    strict = x.withColumn("v", F.when(F.col("v") > 0, F.ln("v")).otherwise(F.raise_error(F.lit("ilr needs positive values")).cast("double")))
    before = Window.partitionBy("obs").orderBy("attr").rowsBetween(Window.unboundedPreceding, -1)
    i = F.row_number().over(by_obs("attr")) - 1
    rows = strict.withColumns({"i": i, "m": F.avg("v").over(before)}).where("i > 0")
    return rows.select("obs", F.col("i").alias("attr"), (F.sqrt(F.col("i") / (F.col("i") + 1)) * (F.col("m") - F.col("v"))).alias("v"))


def ilr_by_basis(x: DataFrame, basis: DataFrame) -> DataFrame:
    """Log-ratios in a basis (``coord``, ``attr``, ``coef``), as of a tree's balances."""
    return clr(x).join(basis, "attr").groupBy("obs", F.col("coord").alias("attr")).agg(F.sum(F.col("v") * F.col("coef")).alias("v"))


def part_weights(x: DataFrame, method: str = "uniform") -> DataFrame:
    """``attr``, ``w`` for balances: ``uniform``, ``gm.counts``, or the norms ``anorm`` and ``enorm`` of an attribute's shares over observations, alone or times ``gm.counts``."""
    if method == "uniform":
        return x.select("attr").distinct().withColumn("w", F.lit(1.0))
    norm, _, mean = method.partition(".x.")
    norm, mean = ("", norm) if norm == "gm.counts" else (norm, mean)
    if norm not in ("", "anorm", "enorm") or mean not in ("", "gm.counts"):
        raise ValueError(f"unknown weights {method!r}")
    log = F.ln("v")
    rows = x.withColumn("p", F.col("v") / F.sum("v").over(Window.partitionBy("attr"))).groupBy("attr").agg(F.exp(F.avg(log)).alias("g"), F.sqrt(F.var_pop(log) * F.count("v")).alias("a"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("e"))
    w = {"": F.lit(1.0), "anorm": F.col("a"), "enorm": F.col("e")}[norm] * (F.col("g") if mean else F.lit(1.0))
    return rows.select("attr", w.alias("w"))


def tree_basis(tree: pd.DataFrame, weights: dict, branches: str = "uniform") -> pd.DataFrame:
    """Balances of a bifurcating tree's inner nodes: ``coord``, ``attr``, ``coef``; ``branches`` scales by the children's lengths (``blw``, ``blw.sqrt``) or their mean distance to leaves (``mean.descendants``)."""
    kids: dict = {}
    for r in tree.itertuples(index=False):
        if r.parent is not None and r.parent == r.parent:
            kids.setdefault(r.parent, []).append((r.node, float(r.length) if r.length is not None and r.length == r.length else 0.0))
    below: dict = {}
    todo = [(r.node, False) for r in tree.itertuples(index=False) if r.parent is None or r.parent != r.parent]
    while todo:
        node, seen = todo.pop()
        if node not in kids:
            below[node] = {node: 0.0}
        elif not seen:
            todo += [(node, True), *((c, False) for c, _ in kids[node])]
        else:
            below[node] = {leaf: d + length for c, length in kids[node] for leaf, d in below[c].items()}
    rows = []
    for node, pair in kids.items():
        if len(pair) != 2:
            raise ValueError(f"{node!r} has {len(pair)} children; see bifurcating()")
        lengths = [max(length, 1e-6) for _, length in pair]
        far = [sum(below[c].values()) / len(below[c]) + length for (c, _), length in zip(pair, lengths, strict=True)]
        scale = {"uniform": 1.0, "blw": sum(lengths), "blw.sqrt": sum(lengths) ** 0.5, "mean.descendants": sum(far)}[branches]
        sums = [sum(weights[leaf] for leaf in below[c]) for c, _ in pair]
        for sign, (c, _), own in ((1, pair[0], sums[0]), (-1, pair[1], sums[1])):
            rows += [(node, leaf, sign * scale * (sums[0] * sums[1] / (sums[0] + sums[1])) ** 0.5 * weights[leaf] / own) for leaf in below[c]]
    return pd.DataFrame(rows, columns=["coord", "attr", "coef"])


def philr(x: DataFrame, tree: pd.DataFrame, parts: str = "uniform", branches: str = "uniform") -> DataFrame:
    """Isometric log-ratios along a tree (``node``, ``parent``, ``length``, ``is_leaf``): other leaves are pruned, polytomies resolved; attributes that are no leaves, absent cells and zeros are errors."""
    from .tree import bifurcating, prune

    weights = {r.attr: r.w for r in part_weights(x, parts).collect()}  # a row a leaf
    strange = set(weights) - set(tree.node[tree.is_leaf])
    if strange:
        raise ValueError(f"not in the tree: {sorted(strange)[:5]}")
    basis = tree_basis(bifurcating(prune(tree, set(weights))), weights, branches)
    w = x.sparkSession.createDataFrame([(a, float(v)) for a, v in weights.items()], f"attr {dict(x.dtypes)['attr']}, w double")
    coefs = x.sparkSession.createDataFrame(list(basis.itertuples(index=False, name=None)), f"coord string, attr {dict(x.dtypes)['attr']}, coef double")
    log = F.when(F.col("v") > 0, F.ln(F.col("v") / F.col("w"))).otherwise(F.raise_error(F.lit("philr needs positive values")).cast("double"))
    sizes = coefs.groupBy("coord").agg(F.count(F.lit(1)).alias("leaves"))
    out = x.join(w, "attr").withColumn("v", log).join(coefs, "attr").groupBy("obs", F.col("coord")).agg(F.sum(F.col("v") * F.col("coef")).alias("v"), F.count("v").alias("n")).join(sizes, "coord")
    whole = F.when(F.col("n") == F.col("leaves"), F.col("v")).otherwise(F.raise_error(F.lit("philr needs all cells; see densify")).cast("double"))
    return out.select("obs", F.col("coord").alias("attr"), whole.alias("v"))


def boxcox(x: DataFrame) -> DataFrame:
    """Box-Cox transform of each observation with the likeliest exponent (positive data)."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        v = g.v.to_numpy(float)
        logs = np.log(v)

        def value(lam: float) -> float:
            y = logs if abs(lam) < 1e-12 else np.expm1(lam * logs) / lam
            s = y.var()
            return -np.inf if s <= 0 else (lam - 1) * logs.sum() - len(v) / 2 * np.log(s)

        lo, hi, golden = -5.0, 5.0, (5**0.5 - 1) / 2
        while hi - lo > 1e-9:
            a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
            lo, hi = (lo, b) if value(a) > value(b) else (a, hi)
        lam = (lo + hi) / 2
        return g.assign(v=logs if abs(lam) < 1e-12 else np.expm1(lam * logs) / lam)[["obs", "attr", "v"]]

    return x.select("obs", "attr", F.col("v").cast("double").alias("v")).groupBy("obs").applyInPandas(fit, x.select("obs", "attr", F.col("v").cast("double").alias("v")).schema)


def size_factors(x: DataFrame, method: str = "rle", p: float = 0.75) -> DataFrame:
    """Per observation ``factor`` (geometric mean 1): median ratio to geometric means (rle), upper quantile or TMM against the observation of median quantile."""
    lib = x.groupBy("obs").agg(F.sum("v").alias("lib"))
    if method == "rle":
        n = x.agg(F.count_distinct("obs").alias("n"))
        means = x.where("v > 0").groupBy("attr").agg(F.avg(F.ln("v")).alias("g"), F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("attr", "g")
        raw = x.join(means, "attr").groupBy("obs").agg(F.percentile(F.col("v") / F.exp("g"), 0.5).alias("f")).join(lib, "obs").withColumn("f", F.col("f") / F.col("lib"))
    elif method == "upperquartile":
        used = x.groupBy("attr").agg(F.sum("v").alias("s")).where("s > 0").select("attr")
        raw = densify(x).join(used, "attr", "left_semi").groupBy("obs").agg(F.percentile("v", p).alias("f")).join(lib, "obs").withColumn("f", F.col("f") / F.col("lib"))
    else:
        return _tmm(x, lib)
    centre = raw.agg(F.exp(F.avg(F.ln("f"))).alias("c"))
    return raw.crossJoin(F.broadcast(centre)).select("obs", "lib", (F.col("f") / F.col("c")).alias("factor"))


def _tmm(x: DataFrame, lib: DataFrame, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    full = densify(x).join(lib, "obs")
    quant = full.groupBy("obs").agg(F.percentile(F.col("v") / F.col("lib"), 0.75).alias("f"))
    mean = quant.agg(F.avg("f").alias("m"))
    ref = quant.crossJoin(F.broadcast(mean)).orderBy(F.abs(F.col("f") - F.col("m")), "obs").limit(1).select("obs")
    base = full.join(F.broadcast(ref), "obs", "left_semi").select("attr", F.col("v").alias("rv"), F.col("lib").alias("rl"))
    pairs = full.join(base, "attr").where("v > 0 and rv > 0")
    m, a = F.log2(F.col("v") / F.col("lib")) - F.log2(F.col("rv") / F.col("rl")), (F.log2(F.col("v") / F.col("lib")) + F.log2(F.col("rv") / F.col("rl"))) / 2
    w = 1 / ((F.col("lib") - F.col("v")) / F.col("lib") / F.col("v") + (F.col("rl") - F.col("rv")) / F.col("rl") / F.col("rv"))
    pairs = pairs.withColumns({"m": m, "a": a, "w": w})
    n = F.count(F.lit(1)).over(by_obs())
    ranks = pairs.withColumns({"n": n, "rm": F.rank().over(by_obs("m")), "ra": F.rank().over(by_obs("a"))})
    lo_m, lo_a = F.floor(F.col("n") * trim_m) + 1, F.floor(F.col("n") * trim_a) + 1
    left = ranks.where((F.col("rm") >= lo_m) & (F.col("rm") <= F.col("n") + 1 - lo_m) & (F.col("ra") >= lo_a) & (F.col("ra") <= F.col("n") + 1 - lo_a))
    raw = left.groupBy("obs").agg(F.pow(F.lit(2.0), F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("f"))
    raw = lib.join(raw, "obs", "left").withColumn("f", F.coalesce("f", F.lit(1.0)))
    centre = raw.agg(F.exp(F.avg(F.ln("f"))).alias("c"))
    return raw.crossJoin(F.broadcast(centre)).select("obs", "lib", (F.col("f") / F.col("c")).alias("factor"))


def scaled(x: DataFrame, method: str, length: DataFrame | None = None, p: float = 0.75) -> DataFrame:
    """Counts per million of the effective library size; ``getmm`` divides by lengths first."""
    if method == "getmm":
        x, method = rpk(x, length), "tmm"
    factors = size_factors(x, method, p)
    return x.join(factors, "obs").select("obs", "attr", (F.col("v") * 1e6 / (F.col("lib") * F.col("factor"))).alias("v"))


def normalize(x: DataFrame, method: str = "tss", axis: int = 1, length: DataFrame | None = None, **options) -> DataFrame:
    """Dispatches on the method's name; ``axis=0`` works on attributes."""
    simple = {"tss": tss, "ratio": tss, "relative-abundance": tss, "center": center, "zscore": zscore, "quantile": quantile, "boxcox": boxcox, "minmax": minmax, "clr": clr, "ilr": ilr, "css": css, "iqlr": iqlr, "xlr": xlr}
    long = {"rpk": rpk, "fpkm": fpkm, "rpkm": fpkm, "tpm": tpm}
    x = transpose(x) if axis == 0 else x
    if method is None:
        out = x
    elif method in simple:
        out = simple[method](x, **options)
    elif method in long:
        out = long[method](x, length)
    elif method in ("rle", "tmm", "upperquartile", "getmm"):
        out = scaled(x, method, length, **options)
    else:
        raise ValueError(f"unknown method {method!r}")
    return transpose(out) if axis == 0 else out
