"""Hand-computed cases: ties, zeros, NULLs, degrees of freedom, rounding, boundaries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import sequences as S
from tessera.functions import special
from tessera.operators import diversity, matrix, network, normalize, ordination, pairs, regress, select, stats, temporal, tree
from tessera.operators.dataset import Dataset


@pytest.fixture(scope="module")
def x(spark):
    rows = [("o1", "a", 1.0), ("o1", "b", 3.0), ("o1", "c", 0.0), ("o2", "a", 2.0), ("o2", "b", 2.0), ("o2", "c", 2.0), ("o3", "a", 0.0), ("o3", "b", 0.0), ("o3", "c", 0.0), ("o4", "a", 5.0)]
    return spark.createDataFrame(rows, "obs string, attr string, v double")


def cells(df):
    return {(r.obs, r.attr): r.v for r in df.collect()}


def test_tss_of_zero_observation_is_null(x):
    got = cells(normalize.tss(x))
    assert got["o1", "b"] == 0.75 and got["o3", "a"] is None and got["o4", "a"] == 1.0


def test_zscore_degrees_of_freedom(x):
    assert cells(normalize.zscore(x))["o1", "b"] == pytest.approx((3 - 4 / 3) / np.std([1, 3, 0]))
    assert cells(normalize.zscore(x, 1))["o1", "b"] == pytest.approx((3 - 4 / 3) / np.std([1, 3, 0], ddof=1))
    assert cells(normalize.zscore(x))["o2", "a"] is None


def test_minmax_of_constant_is_low_end(x):
    got = cells(normalize.minmax(x, 2, 4))
    assert got["o2", "a"] == 2 and got["o1", "b"] == 4 and got["o1", "a"] == pytest.approx(2 + 2 / 3)


def test_quantile_ties_take_lowest_rank(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 4.0), (2, "a", 2.0), (2, "b", 6.0), (2, "c", 8.0)], "obs int, attr string, v double")
    got = cells(normalize.quantile(x))
    assert got[1, "a"] == got[1, "b"] == 1.5 and got[1, "c"] == 6.0 and got[2, "b"] == 3.5


def test_css_by_hand(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 4.0), (1, "d", 0.0)], "obs int, attr string, v double")
    got = cells(normalize.css(x))
    assert got[1, "a"] == pytest.approx(1 / 0.003) and got[1, "d"] == 0.0


def test_lengths_missing_is_an_error(spark, x):
    lengths = spark.createDataFrame([("a", 2.0)], "attr string, length double")
    with pytest.raises(Exception, match="no length of"):
        normalize.rpk(x, lengths).collect()


def test_log_ratios_sum_to_zero(x):
    sums = normalize.clr(x).groupBy("obs").agg(F.sum("v").alias("s")).collect()
    assert all(abs(r.s) < 1e-12 for r in sums)
    with pytest.raises(Exception, match="positive"):
        normalize.ilr(x).collect()


def test_ilr_keeps_aitchison_distance(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 4.0)], "obs int, attr string, v double")
    a = sum(r.v**2 for r in normalize.clr(x).collect())
    assert sum(r.v**2 for r in normalize.ilr(x).collect()) == pytest.approx(a)


def test_boxcox_of_lognormal_is_near_log(spark):
    v = np.exp(np.random.RandomState(0).normal(size=200))
    x = spark.createDataFrame([(1, i, float(a)) for i, a in enumerate(v)], "obs int, attr int, v double")
    got = np.array([r.v for r in normalize.boxcox(x).orderBy("attr").collect()])
    assert np.corrcoef(got, np.log(v))[0, 1] > 0.999


@pytest.mark.parametrize("method", ["rle", "upperquartile", "tmm"])
def test_size_factors_have_geometric_mean_one(spark, method):
    rng = np.random.RandomState(1)
    x = spark.createDataFrame([(o, a, float(rng.poisson(50 * (o + 1)) + 1)) for o in range(4) for a in range(30)], "obs int, attr int, v double")
    f = [r.factor for r in normalize.size_factors(x, method).collect()]
    assert np.mean(np.log(f)) == pytest.approx(0, abs=1e-9) and max(f) < 1.3
    assert normalize.normalize(x, method).count() == 120


def test_unknown_method(x):
    with pytest.raises(ValueError):
        normalize.normalize(x, "nothing")


def test_filters_half_to_even_and_intervals(spark):
    x = spark.createDataFrame([(o, a, 1.0) for o in range(5) for a in ("p", "q")[: 1 + (o < 2)]], "obs int, attr string, v double")
    # 5 * 0.5 = 2.5 rounds to 2: q has prevalence 2 and stays when closed, goes when open
    assert {r.attr for r in matrix.filter_compositional(x, prevalence=0.5).collect()} == {"p", "q"}
    assert {r.attr for r in matrix.filter_compositional(x, prevalence=0.5, interval="open", richness=0, count=0).collect()} == {"p"}


def test_alpha_diversity(x):
    got = {r.obs: r for r in diversity.alpha_diversity(x).collect()}
    assert got["o2"].entropy == pytest.approx(math.log2(3)) and got["o2"].gini == pytest.approx(0)
    assert got["o1"].singletons == 1 and got["o1"].richness == 2 and "o3" not in got and got["o4"].entropy == 0


def test_prevalence_boundaries(x):
    closed = {r.tolerance: r.n_attributes for r in diversity.prevalence(x).collect()}
    opened = {r.tolerance: r.n_attributes for r in diversity.prevalence(x, "open").collect()}
    assert closed == {1: 3, 2: 2, 3: 1, 4: 0} and opened == {1: 2, 2: 1, 3: 0, 4: 0}


def test_taxonomy_ties_give_both(spark):
    hits = spark.createDataFrame([(1, "x", 50.0), (1, "y", 50.0), (2, "x", 90.0), (2, "y", 10.0)], "grp int, taxon string, identity double")
    got = {r.grp: r for r in diversity.infer_taxonomy(hits).collect()}
    assert got[1].taxa == ["x", "y"] and got[2].taxa == ["x"] and got[2].score == pytest.approx(0.9)


def test_enrichment_tail(spark):
    sets = spark.createDataFrame([("s", f) for f in range(5)] + [("t", f) for f in range(3, 10)], "set_name string, feature int")
    query = spark.createDataFrame([(f,) for f in (0, 1, 2, 3)], "feature int")
    got = {r.set_name: r for r in diversity.enrichment(query, sets).collect()}
    want = sum(math.comb(5, k) * math.comb(5, 4 - k) for k in (4,)) / math.comb(10, 4)
    assert got["s"].overlap == 4 and got["s"].p_value == pytest.approx(want)


def test_kl_is_infinite_without_support(spark):
    p = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "attr string, v double")
    q = spark.createDataFrame([("a", 1.0)], "attr string, v double")
    assert diversity.kullback_leibler(p, q).head().kl == math.inf


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, None, 0.02, 0.04]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p_value double")
    get = lambda m: [r.q_value for r in stats.p_adjust(df, method=m).orderBy("i").collect()]
    assert get("bonferroni")[:3] == pytest.approx([0.05, 0.2, 0.15]) and get("bonferroni")[3] is None
    assert get("fdr_bh")[0] == pytest.approx(0.04) and get("fdr_bh")[1] == pytest.approx(0.04)
    assert get("holm")[0] == pytest.approx(0.05) and get("simes-hochberg")[0] == pytest.approx(0.04)
    hommel = get("hommel")
    assert all(a <= b + 1e-12 for a, b in zip([v for v in hommel if v is not None and not math.isnan(v)], [0.04] * 5, strict=True))
    assert get("sidak")[0] == pytest.approx(1 - 0.99**5)


def test_symbols(spark):
    df = spark.createDataFrame([(0.05,), (0.01,), (0.00005,), (0.2,), (None,)], "p double")
    assert [r.s for r in df.select(stats.symbols(F.col("p")).alias("s")).collect()] == ["*", "**", "****", "ns", ""]


def test_tails():
    assert special.t_sf2(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)
    assert special.chi2_sf(3.84145882, 1) == pytest.approx(0.05, abs=1e-8)
    assert special.f_sf(4.96460274, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.norm_sf2(1.959963985) == pytest.approx(0.05, abs=1e-9)


def test_distances_and_correlations(spark):
    rng = np.random.RandomState(0)
    m = rng.randint(0, 4, (12, 3)).astype(float)
    x = spark.createDataFrame([(i, "abc"[j], float(m[i, j])) for i in range(12) for j in range(3)], "obs int, attr string, v double")
    got = {n: {(r.node_a, r.node_b): r.weight for r in pairs.pairwise(x, n).collect()} for n in ("euclidean", "canberra", "jaccard", "pearson", "kendall", "bicor", "mannwhitneyu")}
    a, b = m[:, 0], m[:, 1]
    assert got["euclidean"]["a", "b"] == pytest.approx(np.linalg.norm(a - b))
    assert got["pearson"]["a", "b"] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert -1 <= got["kendall"]["a", "b"] <= 1 and -1.0000001 <= got["bicor"]["a", "b"] <= 1.0000001
    assert pairs.pairwise(x, lambda p, q: float(np.abs(p - q).max())).where("node_a = 'a' and node_b = 'b'").head().weight == np.abs(a - b).max()
    d = pairs.pairwise(x, "pearson", association="dissimilarity").where("node_a = 'a' and node_b = 'b'").head().weight
    assert d == pytest.approx(1 - (np.corrcoef(a, b)[0, 1] + 1) / 2)


def test_log_fold_change_of_zero(spark):
    x = spark.createDataFrame([(1, "a", 0.0), (2, "a", 4.0)], "obs int, attr string, v double")
    one, two = (spark.createDataFrame([(i,)], "obs int") for i in (1, 2))
    assert pairs.log_fold_change(x, one, two).head().v == math.inf and pairs.difference(x, one, two).head().v == 4


def test_network_by_hand(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5)], "node_a string, node_b string, weight double")
    assert {r.node: r.k for r in network.connectivity(e).collect()} == {"a": 1.0, "b": 1.5, "c": 0.5}
    tom = {(r.node_a, r.node_b): r.weight for r in network.topological_overlap(e).collect()}
    assert tom["a", "b"] == pytest.approx(1.0) and tom["a", "c"] == pytest.approx(0.5 / 1.5)
    r = e.select(network.edge_struct(F.col("node_b"), F.col("node_a"), F.lit(-2.0)).alias("e")).head().e
    assert (r.node_a, r.node_b, r.weight, r.sign, r.directed) == ("a", "b", 2.0, -1, False)
    assert e.select(network.edge_struct(F.lit("x"), F.lit("x"), F.lit(1.0)).alias("e")).head().e.directed is None


def test_communities_of_two_cliques(spark):
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(4) for j in range(i + 1, 4)] + [("a0", "b0", 0.1)]
    e = spark.createDataFrame(rows, "node_a string, node_b string, weight double")
    labels = {r.node: r.label for r in network.communities(e).collect()}
    assert len({labels[f"a{i}"] for i in range(4)}) == 1 and labels["a1"] != labels["b1"]
    parts = network.community_detection(e, 3).groupBy("iter").agg(F.count_distinct("cluster").alias("n")).collect()
    assert all(r.n == 2 for r in parts)


def test_temporal_paths(spark):
    e = spark.createDataFrame([(1.0, "a", "b", 1.0), (2.0, "b", "c", 1.0), (1.0, "c", "d", 1.0)], "t double, node_a string, node_b string, weight double")
    got = {r.node: r.t0 for r in temporal.earliest_arrival(e, "a").collect()}
    assert got["b"] == 1.0 and got["c"] == 2.0 and "d" not in got
    assert temporal.volatility(e).head().changes == 3


def test_linkage_newick_and_cut(spark):
    d = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0]], float)
    z = tree.linkage(d, "average")
    assert z[:, 2].tolist() == [1, 2, 4.5] and tree.newick(z, list("abcd")).count("(") == 3
    assert tree.cut(z, 2, 2).tolist() == [0, 0, 1, 1] and tree.cut(z, 1, 2).tolist() == [0, 0, -1, -1]
    t = spark.createDataFrame(tree.parse_newick("((a:1,b:2):1,c:3);"))
    got = {(r.node_a, r.node_b): r.weight for r in tree.leaf_distances(t, False).collect()}
    assert got == {("a", "b"): 3.0, ("a", "c"): 5.0, ("b", "c"): 6.0}


def test_pca_and_procrustes(spark):
    rng = np.random.RandomState(0)
    m = rng.normal(size=(30, 3)) * [5, 1, 0.1]
    x = spark.createDataFrame([(i, "abc"[j], float(m[i, j])) for i in range(30) for j in range(3)], "obs int, attr string, v double")
    c = ordination.pca(x)
    ratio = [r.ratio for r in c.explained.orderBy("pc").collect()]
    s = np.linalg.svd(m - m.mean(axis=0), compute_uv=False) ** 2
    assert ratio == pytest.approx(list(s / s.sum())) and ordination.cumulative(c.explained, 0.9).head().pc == "PC1"
    turn = np.array([[0, 1], [-1, 0]])
    assert ordination.procrustes(m[:, :2], m[:, :2] @ turn * 3 + 1).ss == pytest.approx(0, abs=1e-12)
    assert ordination.protest(spark, m[:, :2], m[:, :2] @ turn, 49) == pytest.approx(1 / 50)


def test_regressions(spark):
    rng = np.random.RandomState(0)
    z, g = rng.normal(size=60), np.repeat(np.arange(6), 10)
    y = 1 + 2 * z + rng.normal(size=6)[g] + 0.1 * rng.normal(size=60)
    x = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(y)], "obs int, attr string, v double")
    meta = spark.createDataFrame([(i, float(z[i]), f"g{g[i]}") for i in range(60)], "obs int, z double, g string")
    got = {r.term: r for r in regress.glm(x, meta, ["z"]).collect()}
    slope, intercept = np.polyfit(z, y, 1)
    assert got["z"].coef == pytest.approx(slope) and got["Intercept"].coef == pytest.approx(intercept)
    got = {r.term: r for r in regress.mixed(x, meta, ["z"], "g").collect()}
    assert got["z"].coef == pytest.approx(2, abs=0.05) and got["Group Var"].coef > 0.1
    assert regress.graph(regress.glm(x, meta, ["z"])).head().sign == 1
    counts = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(rng.poisson(np.exp(0.5 + 0.3 * z)))], "obs int, attr string, v double")
    assert {r.term: r.coef for r in regress.glm(counts, meta, ["z"], "poisson").collect()}["z"] == pytest.approx(0.3, abs=0.3)


def test_selection_finds_the_telling_feature(spark):
    rng = np.random.RandomState(0)
    rows = [(i, f"f{j}", float(rng.normal() + (3 * (i % 2) if j == 0 else 0))) for i in range(60) for j in range(4)]
    x = spark.createDataFrame(rows, "obs int, attr string, v double")
    y = spark.createDataFrame([(i, str(i % 2)) for i in range(60)], "obs int, class string")
    for kind, params in (("logistic", [{"c": 1.0, "penalty": "l1"}]), ("tree", [{"criterion": "gini", "min_samples_leaf": 2}])):
        w = select.weights(select.kernel(x, y, kind, 2, params=params))
        assert w.orderBy(F.desc("weight")).head().attr == "f0" and w.agg(F.sum("weight")).head()[0] == pytest.approx(1)
    scores = select.cross_validate(x, y, ["f0", "f1", "f2", "f3"], "logistic", folds=5)
    assert scores.count() == 3 and select.best_model(scores).head().accuracy > 0.85
    assert select.until_stale(scores, 100).count() == 3


def test_descent_and_products(spark):
    e = spark.createDataFrame([(1, "r", "x", 0.6), (1, "r", "c", 0.4), (1, "x", "a", 0.5), (1, "x", "b", 0.5)], "obs int, parent string, child string, p double")
    paths = spark.createDataFrame([("a", "r", "x"), ("a", "x", "a"), ("b", "r", "x"), ("b", "x", "b"), ("c", "r", "c")], "target string, parent string, child string")
    p = select.path_probabilities(e, paths)
    assert {r.target: round(r.p, 6) for r in p.collect()} == {"a": 0.3, "b": 0.3, "c": 0.4}
    assert select.most_likely(p).head().target == "c" and select.descend(e, "r").head().node == "b"


def test_kmers_and_strands(spark):
    s = spark.createDataFrame([(1, "ACGTN"), (2, "AAA"), (3, "AC")], "seq_id int, seq string")
    got = {(r.seq_id, r.kmer): r.v for r in S.count_kmers(s, 3, frequency=False).collect()}
    assert got == {(1, "ACG"): 1, (1, "CGT"): 1, (2, "AAA"): 1}
    got = {(r.seq_id, r.kmer): r.v for r in S.count_kmers(s, 3, collapse=True, frequency=False).collect()}
    assert got == {(1, "ACG"): 2, (2, "AAA"): 1}
    assert s.select(S.reverse_complement(F.col("seq")).alias("r")).head().r == "NACGT"
    h = s.limit(1).select(S.hash_kmer(F.lit("ACG")).alias("a"), S.hash_kmer(F.lit("CGT")).alias("b")).head()
    assert h.a == h.b


def test_murmur_known_value():
    import pandas as pd

    assert S.murmur3(pd.Series(["hello"])).tolist() == [613153351]


def test_dataset(spark, x):
    ds = Dataset(x)
    ds["tss"] = normalize.tss(x)
    ds.add_subset("few", spark.createDataFrame([("o1",)], "obs string"))
    assert len(ds) == 2 and "tss" in ds and ds.get("tss", obs="few").count() == 3 and ds.get(obs=["o4"], attr=lambda c: c == "a").count() == 1
    with pytest.raises(KeyError):
        ds.get(obs=["missing"])
    ds.add_metadata(spark.createDataFrame([("o1", "k")], "obs string, kind string"), "obs")
    ds.set_target("kind")
    assert ds.get(with_target=True)[1].count() == 1 and ds.field("kind", change=F.upper).head().kind == "K"
    del ds["tss"]
    assert list(ds) == ["initial"]


def test_empty_tables(spark):
    x = spark.createDataFrame([], "obs string, attr string, v double")
    for f in (normalize.tss, normalize.clr, diversity.alpha_diversity, diversity.depth_richness, lambda d: pairs.pairwise(d, "euclidean")):
        assert f(x).count() == 0


def test_p_values_of_many_rows_equal_plain_formulas(spark):
    rng = np.random.RandomState(3)
    p = np.round(rng.rand(300) ** 2, 2)  # many ties
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(999, None)], "i int, p_value double").repartition(5)
    m, order = len(p), np.argsort(p, kind="stable")
    s, k = p[order], np.arange(1, m + 1)
    down, up = (lambda v: np.minimum.accumulate(v[::-1])[::-1]), np.maximum.accumulate
    want = {"fdr_bh": down(s * m / k), "fdr_by": down(s * m / k * (1 / k).sum()), "holm": up(s * (m - k + 1)), "holm-sidak": up(1 - (1 - s) ** (m - k + 1)), "simes-hochberg": down(s * (m - k + 1)), "sidak": 1 - (1 - s) ** m, "bonferroni": s * m}
    for method, value in want.items():
        got = {r.i: r.q_value for r in stats.p_adjust(df, method=method).collect()}
        assert got[999] is None and np.allclose([got[i] for i in order], np.minimum(value, 1)), method
        grouped = {r.i: r.q_value for r in stats.p_adjust(df.withColumn("g", F.lit(1)), method=method, by="g").collect()}
        assert np.allclose([grouped[i] for i in order], np.minimum(value, 1)) and grouped[999] is None
    for method, bky in (("fdr_tsbh", False), ("fdr_tsbky", True)):
        got = {r.i: r.q_value for r in stats.p_adjust(df, method=method).collect()}
        assert got[999] is None and np.allclose([got[i] for i in range(m)], stats._two_stage(p, 0.05, bky))


def test_deep_trees_and_circles(spark):
    kind = "node string, parent string, length double, is_leaf boolean"
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, 1.0, i == 149) for i in range(150)], kind)
    got = tree.ancestors(chain).where("node = 'n149'").collect()
    assert len(got) == 150 and all(r.distance == r.steps == 149 - int(r.ancestor[1:]) for r in got)
    with pytest.raises(ValueError):
        tree.ancestors(spark.createDataFrame([("a", "b", 1.0, False), ("b", "a", 1.0, False)], kind))
    taxa = spark.createDataFrame([(1, 2, "one", "genus"), (2, 1, "two", "family"), (3, 1, "three", "species")], "taxon_id int, parent int, name string, rank string")
    from tessera.operators import components

    r = components.lineage(spark.createDataFrame([(3,), (7,)], "taxon_id int"), taxa, ["species", "genus", "family"]).orderBy("taxon_id").collect()
    assert tuple(r[0]) == (3, "three", "one", "two") and tuple(r[1]) == (7, None, None, None)
    circle = spark.createDataFrame([("o", "a", "b", 1.0), ("o", "b", "a", 1.0)], "obs string, parent string, child string, p double")
    with pytest.raises(ValueError):
        select.descend(circle, "a")


def test_preferred_parameters_come_first():
    logistic, trees = select.grid("logistic"), select.grid("tree")
    assert logistic[0] == {"c": 1.0, "penalty": "l2"} and len(logistic) == 40 and min(g["c"] for g in logistic) == 1e-10
    assert trees[0] == {"criterion": "gini", "min_samples_leaf": 1, "max_features": "sqrt"} and len(trees) == 40


def test_zero_replacement(x):
    full = matrix.densify(x)
    assert cells(normalize.replace_zeros(full))["o3", "a"] == pytest.approx(1 / 9)
    with pytest.raises(Exception, match="must not be negative"):
        normalize.transform(full.withColumn("v", -F.col("v"))).collect()


def test_iqlr_reference_comes_from_one_pass(spark):
    x = spark.createDataFrame([(o, f"a{k}", float(1 + (o * (k + 3)) % 11)) for o in range(9) for k in range(9)], "obs int, attr string, v double")
    plan = normalize.iqlr(x)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("var_samp") == 1  # bounds and what is compared with them are the same sums


def test_kendall_of_many_observations(spark):
    rng = np.random.RandomState(4)
    for n, top in ((1, 3), (2, 2), (30, 4), (200, 1000), (150, 9)):
        a, b = rng.randint(top, size=n).astype(float), rng.randint(top, size=n).astype(float)
        p, q = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
        d = np.sqrt((p != 0).sum() * (q != 0).sum())
        got = pairs._kendall(a, b)
        assert np.isnan(got) if d == 0 else abs(got - (p * q).sum() / d) < 1e-12
    many = spark.range(400000).selectExpr("cast(id as int) as obs", "id * 7919 % 100003 as p", "id % 13 as q").selectExpr("obs", "stack(3, 'a', p, 'b', q, 'c', -p) as (attr, v)")  # their square would take 1.3 TB
    got = {(r.node_a, r.node_b): r.weight for r in pairs.pairwise(many, "kendall").collect()}
    assert got.keys() == {("a", "b"), ("a", "c"), ("b", "c")} and abs(got["a", "c"] + 1) < 1e-12 and abs(got["a", "b"] + got["b", "c"]) < 1e-12
    flat = spark.createDataFrame([(i, a, float(i * (a == "a"))) for i in range(4) for a in "ab"], "obs int, attr string, v double")
    assert pairs.pairwise(flat, "kendall").head().weight is None
