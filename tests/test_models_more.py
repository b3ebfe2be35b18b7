"""Weights by mode, prediction modes, dispersions, contrasts, communities, hybrid cuts, balances, lines of files."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import collections as U
from tessera.operators import differential, diversity, network, normalize, ordination, select, tree
from tessera.sources import readers


def test_weight_modes(spark):
    rng = np.random.RandomState(0)
    rows = [(i, c, a, float(rng.normal()), float(acc)) for i, acc in enumerate((0.0, 0.2, 0.5, 0.95)) for c in "xy" for a in "pqr"]
    k = spark.createDataFrame(rows, "iter int, class string, attr string, weight double, accuracy double")
    t = pd.DataFrame(rows, columns=["iter", "class", "attr", "weight", "accuracy"]).assign(w=lambda d: d.weight.abs())

    def at(threshold):
        w = t[t.accuracy > threshold].groupby("attr").w.sum()
        return w / w.sum()

    got = {r.attr: r.weight for r in select.extract_weights(k, 0, 0.3).collect()}
    assert all(got[a] == pytest.approx(at(0.3)[a]) for a in "pqr")
    one = {(round(r.threshold, 9), r.attr): r.weight for r in select.extract_weights(k, 1).collect()}
    steps = np.linspace(0, 0.9, 100)
    assert len(one) == 300 and all(one[round(s, 9), a] == pytest.approx(at(s)[a]) for s in steps for a in "pqr")
    total = sum(at(s) for s in steps)
    whole = {r.attr: r.weight for r in select.extract_weights(k, 2).collect()}
    assert all(whole[a] == pytest.approx((total / total.sum())[a]) for a in "pqr") and whole == {r.attr: r.weight for r in select.extract_weights(k).collect()}
    by = t.groupby(["class", "attr"]).w.sum()
    three = {(r["class"], r.attr): r.weight for r in select.extract_weights(k, 3).collect()}
    assert all(three[c, a] == pytest.approx(by[c, a] / by[c].sum()) for c in "xy" for a in "pqr")
    squared = {r.attr: r.weight for r in select.extract_weights(k, 0, 0.3, lambda w: w * w).collect()}
    assert squared["p"] == pytest.approx(t[t.accuracy > 0.3].groupby("attr").w.sum()["p"] ** 2 / (t[t.accuracy > 0.3].groupby("attr").w.sum() ** 2).sum())
    assert select.extract_weights(k, 0, 0.99).isEmpty()
    assert select.sizes(20, "adaptive") == [*range(1, 10), 10] and select.sizes(4) == [1, 2, 3]


def _hierarchy(spark):
    rng = np.random.RandomState(1)
    names = [("a", "x"), ("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")]
    centre = {"a": (0, 0), "b": (0, 6), "c": (9, 0), "d": (9, 6)}
    truth = [(i, *names[i % 5]) for i in range(60)]
    x = spark.createDataFrame([(i, f, float(centre[t][j] + rng.normal())) for i, t, _ in truth for j, f in enumerate("pq")], "obs int, attr string, v double")
    targets = spark.createDataFrame([(i, "root", g) for i, _, g in truth] + [(i, g, t) for i, t, g in truth], "obs int, submodel string, child string")
    attributes = spark.createDataFrame([(m, f) for m in ("root", "x", "y") for f in "pq"], "submodel string, attr string")
    paths = spark.createDataFrame([(t, "root", g, 1) for t, g in (("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"))] + [(t, g, t, 2) for t, g in (("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"))], "target string, parent string, child string, step int")
    return x, targets, attributes, paths, spark.createDataFrame([(i, t) for i, t, _ in truth], "obs int, class string")


def test_prediction_modes(spark):
    x, targets, attributes, paths, truth = _hierarchy(spark)
    edges = select.fit_submodels(x, targets, attributes).cache()
    want = {r.obs: r["class"] for r in truth.collect()}
    for mode in ("directional", "diffuse"):
        got = {r.obs: r.target for r in select.predict(edges, paths, mode).collect()}
        assert sum(got[i] == want[i] for i in want) >= 58
    parts = {(r.obs, r.submodel): r.child for r in select.predict(edges, paths, "component").collect()}
    p = {(r.obs, r.parent, r.child): r.p for r in edges.collect()}
    assert len(parts) == 180 and all(p[o, m, c] == max(v for (q, n, _), v in p.items() if (q, n) == (o, m)) for (o, m), c in list(parts.items())[:30])
    soft = select.path_probabilities(edges, paths, "softmax").where("obs = 0")
    raw = {t: p[0, "root", g] * p[0, g, t] for t, g in (("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"))}
    assert {r.target: pytest.approx(r.p) for r in soft.collect()} == {t: math.exp(v) / sum(map(math.exp, raw.values())) for t, v in raw.items()}
    ranks = select.path_probabilities(edges, paths, lambda v, w: v / F.max(v).over(w)).groupBy("obs").agg(F.max("p").alias("m"))
    assert ranks.where("m <> 1").isEmpty()
    weight = spark.createDataFrame([("root", "x", 0.5), ("x", "a", 0.25)], "parent string, child string, weight double")
    assert [(r.step, r.weight) for r in select.cumulative_weights(paths.where("target = 'a'"), weight).orderBy("step").collect()] == [(1, 0.5), (2, 0.125)]
    with pytest.raises(ValueError):
        select.predict(edges, paths.unionByName(spark.createDataFrame([("z", "other", "z", 1)], paths.schema)))
    folds = select.whole_accuracy(x, targets, attributes, paths, truth, 3).collect()
    assert len(folds) == 3 and all(r.accuracy > 0.8 for r in folds)
    alone = {r.submodel: r.accuracy for r in select.validate_submodels(x, targets, attributes, 3).collect()}
    assert set(alone) == {"root", "x", "y"} and min(alone.values()) > 0.85


def test_mixed_models():
    rng = np.random.RandomState(0)
    y = np.array(["u", "v"] * 40)
    x = rng.normal(size=(80, 4))
    x[:, 1] += 3 * (y == "u")
    x[:, 2] += 3 * (y == "u")
    model = select.make("mixed", {"parts": [("logistic", {}, [0, 1]), ("tree", {"min_samples_leaf": 3}, [2, 3])]}).fit(x, y)
    assert (model.predict(x) == y).mean() > 0.93 and np.allclose(model.proba(x).sum(axis=1), 1)


def _nb(spark, groups, effect=6.0):
    rng = np.random.RandomState(0)
    rows = [(o, f"a{a:02d}", float(rng.negative_binomial(5, 5 / (5 + 100 * (effect if a == 0 and groups[o] == "case" else 1))))) for o in range(len(groups)) for a in range(30)]
    return spark.createDataFrame(rows, "obs int, attr string, v double"), spark.createDataFrame(list(enumerate(groups)), "obs int, class string"), rows


def test_contrasts_and_dispersions(spark):
    groups = ["ref"] * 6 + ["case"] * 6 + ["other"] * 6
    x, y, rows = _nb(spark, groups)
    for scope in ("global", "local"):
        out = differential.glm_test(x, y, "ref", scope=scope)
        assert out.count() == 60 and out.where("p_value between 0 and 1 and fdr >= p_value - 1e-12").count() == 60
        best = out.where("treatment = 'case'").orderBy("p_value").head()
        assert best.attr == "a00" and 1.5 < best.log_fc < 4
        assert out.where("fdr < 0.05 and attr <> 'a00'").count() <= 3
    batch = spark.createDataFrame([(o, c, float(v)) for o, g in enumerate(groups) for c, v in (("one", 1), ("case", g == "case"), ("batch", o % 2))], "obs int, column string, v double")
    both = differential.glm_test(x, y, "ref", design=batch, contrasts={"case": {"case": 1.0}, "batch": {"batch": 1.0}})
    assert both.where("treatment = 'case'").orderBy("p_value").head().attr == "a00" and both.where("treatment = 'batch' and attr = 'a00'").head().p_value > 0.001
    designed = differential._designed(x, y)[0]
    phi = {m: [r.phi for r in differential.dispersions(designed, m).collect()] for m in ("common", "trended", "tagwise")}
    assert len(set(phi["common"])) == 1 and 0.1 < phi["common"][0] < 0.4  # drawn at 0.2
    assert np.var(phi["tagwise"]) > 0 and all(0.01 < v < 2 for v in phi["tagwise"])
    with pytest.raises(ValueError):
        differential.glm_test(x, y, "none")
    with pytest.raises(ValueError):
        differential.glm_test(x, y, "ref", contrasts={"q": {"q": 1.0}})
    two = y.where("class <> 'other'")
    exact = differential.exact_test(x.join(two.select("obs"), "obs", "left_semi"), two, "ref", "tagwise")
    assert exact.orderBy("p_value").head().attr == "a00"


@pytest.mark.parametrize("total,own,a,b", [(0, 0, 2.0, 3.0), (40, 31, 4.0, 6.0), (1000, 400, 2.5, 0.5), (7, 7, 0.2, 0.3)])
def test_split_tail_in_pieces(total, own, a, b):
    log = np.array([math.lgamma(k + a) - math.lgamma(k + 1) + math.lgamma(total - k + b) - math.lgamma(total - k + 1) for k in range(total + 1)])
    p = np.exp(log - log.max())
    want = p[log <= log[own] + 1e-7].sum() / p.sum()
    for chunk in (1, 7, 1 << 16):
        assert differential._split_tail(total, own, a, b, chunk) == pytest.approx(want, rel=1e-6)


def _cliques(spark, n=6, size=5):
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abcdef"[:n] for i in range(size) for j in range(i + 1, size)] + [(f"{p}0", f"{q}0", 0.5) for p, q in itertools.pairwise("abcdef"[:n])]
    return spark.createDataFrame(rows, "node_a string, node_b string, weight double"), rows


def test_communities_on_both_paths(spark):
    edges, rows = _cliques(spark)
    for limit in (0, 10**6):
        out = network.louvain(edges, driver_edges=limit)
        label = {r.node: r.cluster for r in out.collect()}
        assert len(label) == 30 and all(len({label[f"{g}{i}"] for i in range(5)}) == 1 for g in "abcdef") and len(set(label.values())) == 6
        m = sum(w for *_, w in rows)
        degree = {v: sum(w for a, b, w in rows if v in (a, b)) for v in label}
        want = sum(w for a, b, w in rows if label[a] == label[b]) / m - sum(sum(degree[v] for v in label if label[v] == c) ** 2 for c in set(label.values())) / (4 * m * m)
        assert network.modularity(edges, out).head()[0] == pytest.approx(want)
    parts = network.community_detection(edges, 4).groupBy("iter").agg(F.count_distinct("cluster").alias("n")).collect()
    assert [r.n for r in parts] == [6] * 4
    # a ring of cliques merges in pairs only on the second level
    found = network.partition(*(np.array(v) for v in zip(*[(i, (i + 1) % 40, 1.0) for i in range(40)], strict=True)), 40)
    assert 4 <= len(set(found)) <= 8
    with pytest.raises(ValueError):
        network.community_detection(edges, 1, limit=3)


def test_ensembles(spark):
    rng = np.random.RandomState(0)
    x = spark.createDataFrame([(o, a, float(rng.normal() + (o if a != "z" else 0))) for o in range(10) for a in "xyz"], "obs int, attr string, v double")
    out = network.ensemble(x, "spearman", 12, statistics=("mean", "median"), extra={"low": F.min})
    assert out.columns == ["node_a", "node_b", "mean", "median", "low"] and out.where("node_a = 'x' and node_b = 'y'").head()["mean"] > 0.7
    assert network.ensemble(x, "bicor", 5, replacement=True).count() == 3
    assert network.ensemble(x, "cityblock", 5).where("mean <= 0").isEmpty() and network.ensemble(x, lambda a, b: F.max(F.abs(a - b)), 5).count() == 3
    assert network.ensemble(x, n_iter=5, transformation=lambda c: c.withColumn("v", F.col("v") * 2)).count() == 3
    with pytest.raises(ValueError):
        network.ensemble(x.where("obs < 3"), n_iter=100)


def test_hybrid_cut(spark):
    rng = np.random.RandomState(0)
    points = np.vstack([rng.normal(c, 0.3, size=(n, 2)) for c, n in (((0, 0), 12), ((8, 0), 9), ((0, 8), 6))] + [[[30, 30]]])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    z = tree.linkage(d, "average")
    label = tree.hybrid_cut(z, d, min_size=4, height=20.0)
    assert label.tolist() == [0] * 12 + [1] * 9 + [2] * 6 + [-1]
    assert (tree.hybrid_cut(z, d, min_size=50) == -1).all() and tree.hybrid_cut(np.empty((0, 4)), np.zeros((1, 1)), 3).tolist() == [-1]
    edges = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(27) for j in range(i + 1, 27)], "node_a int, node_b int, weight double")
    got = {r.node: r.cluster for r in tree.clusters(edges, "average").collect()}
    assert [got[i] for i in range(27)] == [0] * 12 + [1] * 9 + [2] * 6
    assert tree.clusters(edges, "average", "static", height=3.0).where("cluster = 0").count() == 12
    leaves = spark.createDataFrame([("a",), ("b",)], "node string")
    track = spark.createDataFrame([("a", 1.5)], "node string, v double")
    assert {r.node: r.size for r in tree.with_track(leaves, track, "size", 0.0).collect()} == {"a": 1.5, "b": 0.0}
    with pytest.raises(ValueError):
        tree.with_track(leaves.where("node = 'b'"), track, "size")


@pytest.mark.parametrize("parts", ["uniform", "gm.counts", "anorm", "enorm", "anorm.x.gm.counts", "enorm.x.gm.counts"])
@pytest.mark.parametrize("branches", ["uniform", "blw", "blw.sqrt", "mean.descendants"])
def test_balances(spark, parts, branches):
    t = tree.parse_newick("((a:1,b:2):1,(c:3,(d:1,e:4):2):1,gone:1);")
    rng = np.random.RandomState(0)
    v = rng.uniform(1, 9, size=(4, 5))
    x = spark.createDataFrame([(o, "abcde"[a], float(v[o, a])) for o in range(4) for a in range(5)], "obs int, attr string, v double")
    logs, shares = np.log(v), v / v.sum(axis=0)
    gm, anorm, enorm = np.exp(logs.mean(axis=0)), np.sqrt(((logs - logs.mean(axis=0)) ** 2).sum(axis=0)), np.sqrt((shares**2).sum(axis=0))
    p = {"uniform": np.ones(5), "gm.counts": gm, "anorm": anorm, "enorm": enorm, "anorm.x.gm.counts": anorm * gm, "enorm.x.gm.counts": enorm * gm}[parts]
    got = {(r.obs, r.attr): r.v for r in normalize.philr(x, t, parts, branches).collect()}
    assert len(got) == 16
    y, at = np.log(v / p), {c: i for i, c in enumerate("abcde")}

    def balance(left, right):
        left, right = [at[c] for c in left], [at[c] for c in right]
        m, n = p[left].sum(), p[right].sum()
        return np.sqrt(m * n / (m + n)) * (y[:, left] @ p[left] / m - y[:, right] @ p[right] / n)

    scale = {"uniform": (1, 1), "blw": (3, 5), "blw.sqrt": (3**0.5, 5**0.5), "mean.descendants": (3, 5)}[branches]
    columns = [np.array([got[o, c] for o in range(4)]) for c in sorted({c for _, c in got})]
    for want in (balance("a", "b") * scale[0], balance("d", "e") * scale[1]):
        assert any(np.allclose(np.abs(c), np.abs(want)) for c in columns)


def test_balances_need_leaves(spark):
    t = tree.parse_newick("((a:1,b:2):1,c:3);")
    x = spark.createDataFrame([(1, "a", 1.0), (1, "z", 1.0)], "obs int, attr string, v double")
    with pytest.raises(ValueError):
        normalize.philr(x, t)


def test_neighbour_embedding(spark):
    rng = np.random.RandomState(0)
    points = np.vstack([rng.normal(c, 0.2, size=(10, 3)) for c in (0, 5)])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    edges = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(20) for j in range(i + 1, 20)], "node_a int, node_b int, weight double")
    labels, y = ordination.neighbour_embedding(edges, perplexity=5, steps=200)
    gap = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    np.fill_diagonal(gap, np.inf)
    near = gap.argmin(axis=1)
    assert labels == list(range(20)) and ((near < 10) == (np.arange(20) < 10)).all()


def test_lines_of_many_splits(spark, tmp_path):
    for name, n in (("one.txt", 700), ("two.txt", 30), ("none.txt", 0)):
        (tmp_path / name).write_text("".join(f"  {name} {i}\t\n" if i % 7 else "\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = readers.read_textfile(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(r.file.rsplit("/", 1)[-1], r.line): r.value for r in rows}
    assert got == {(name, i): f"{name} {i}" if i % 7 else "" for name, n in (("one.txt", 700), ("two.txt", 30)) for i in range(n)} and len(rows) == 730


def test_small_helpers(spark):
    df = spark.sql("select 7 as n, 'YES' as a, 'maybe' as b, 'aXbX' as t, array('p', 'q') as l, array() as e")
    r = df.select(U.pad_left(F.col("n"), 3).alias("pad"), U.pad_left(F.lit("12345"), 3).alias("long"), U.boolean(F.col("a")).alias("yes"), U.boolean(F.col("b")).alias("none"), U.to_precision(F.lit(1.23456), 2).alias("p"), U.consecutive_replace(F.col("t"), [("X", "Y"), ("aY", "z")]).alias("c"), U.join_as_strings("-", F.col("n"), F.lit(None), F.col("a")).alias("j"), U.range_like(F.col("l")).alias("r"), U.range_like(F.col("e")).alias("r0")).head()
    assert tuple(r) == ("007", "12345", True, None, "1.23", "zbY", "7-YES", [0, 1], [])
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.5), ("a", "c", 1.0)], "node_a string, node_b string, weight double")
    assert tuple(U.asymmetry(e).head()) == (0.5, 1)
    assert {r.weight: r.node_b for r in U.collapse(e, "node_b", "weight").collect()} == {1.0: ["b", "c"], 1.5: ["a"]}
    x = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0)], "obs int, attr string, v double")
    assert diversity.alpha_diversity(x, metric=lambda v, p: 1 - F.sum(p * p)).head().value == pytest.approx(0.375)
    hits = spark.createDataFrame([("g", "T", 90.0, "s1"), ("g", "U", 95.0, "s2")], "grp string, taxon string, identity double, seq string")
    domains = spark.createDataFrame([("s1", "d"), ("s2", "e")], "seq string, domain string")
    assert diversity.infer_taxonomy(hits, domains, ["d"]).head().taxa == ["T"] and diversity.infer_taxonomy(hits, domains).head().taxa == ["U"]


def test_hommel_by_definition():
    from tessera.operators.stats import _hommel

    def slow(p):
        n, out = len(p), np.zeros(len(p))
        for m in range(1, n + 1):
            for members in itertools.combinations(range(n), m):
                v = np.sort(p[list(members)])
                simes = (m * v / np.arange(1, m + 1)).min()
                out[list(members)] = np.maximum(out[list(members)], simes)
        return np.minimum(out, 1)

    rng = np.random.RandomState(0)
    for k in range(60):
        n = 1 + k % 9
        p = rng.uniform(size=n) ** rng.randint(1, 5)
        p = np.round(p, 1 + k % 3) if k % 2 else p
        assert np.allclose(_hommel(p), slow(p), atol=1e-12), p
    assert len(_hommel(np.zeros(0))) == 0 and len(_hommel(rng.uniform(size=100_000))) == 100_000


@pytest.mark.parametrize("metric", ["pearson", "euclidean", "cityblock", "chebyshev"])
def test_perturbation(spark, metric):
    rng = np.random.RandomState(0)
    m = rng.normal(size=(8, 3))
    x = spark.createDataFrame([(o, "abc"[a], float(m[o, a])) for o in range(8) for a in range(3)], "obs int, attr string, v double")
    got = {(r.sample, r.node_a, r.node_b): r.weight for r in network.sample_perturbation(x, x.where("obs < 6").select("obs").distinct(), metric).collect()}
    f = {"pearson": lambda p, q: np.corrcoef(p, q)[0, 1], "euclidean": lambda p, q: np.linalg.norm(p - q), "cityblock": lambda p, q: np.abs(p - q).sum(), "chebyshev": lambda p, q: np.abs(p - q).max()}[metric]
    assert len(got) == 6
    for (o, a, b), w in got.items():
        i, j, rows = "abc".index(a), "abc".index(b), [*range(6), o]
        assert w == pytest.approx(f(m[rows, i], m[rows, j]) - f(m[:6, i], m[:6, j]))


def test_ensemble_by_products_draws_as_the_long_form(spark):
    from pyspark.sql import Window

    from tessera.operators import subsamples
    from tessera.operators.matrix import densify

    x = spark.range(60).selectExpr("cast(id % 20 as int) as obs", "concat('n', cast(id / 20 as int)) as attr", "cast((id * id) % 23 as double) as v").where("v % 5 <> 1")
    x = x.unionByName(x.where("attr = 'n0'").selectExpr("obs", "'n9' as attr", "7.0 as v"))
    chunk, rows = subsamples.CHUNK, subsamples.ROWS
    subsamples.CHUNK, subsamples.ROWS = 24, 3  # several chunks and blocks
    try:
        for fill, cells in ((0.0, densify(x)), (None, x)):
            size = network.subsample_size(20, 0.618)
            got = {(r.iter, r.node_a, r.node_b): r.v for r in subsamples.correlations(x, 70, size, 20, 3, fill).collect()}
            w = Window.partitionBy("iter").orderBy("u", "obs")
            drawn = x.select("obs").distinct().withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(69)))).withColumn("u", F.xxhash64("obs", "iter", F.lit(3)))
            chosen = drawn.withColumn("r", F.percent_rank().over(w)).where("r < 0.618").select("obs", "iter", F.lit(0).cast("long").alias("copy"))
            want = {(r.iter, r.node_a, r.node_b): r.v for r in network._draws(cells.join(chosen, "obs"), lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))).collect()}
            assert got.keys() == want.keys() and all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items())
            assert None in got.values() or fill is not None
    finally:
        subsamples.CHUNK, subsamples.ROWS = chunk, rows
    plan = network.ensemble(x, n_iter=5, fill=0.0)._jdf.queryExecution().analyzed().toString()
    assert "node_a" in plan and "percent_rank" not in plan  # no table of cells by subsample
    assert network.ensemble(x, n_iter=5, fill=0.0).count() == 6


def test_wide_matrix_is_packed_on_the_cluster(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    x = spark.createDataFrame([(o, f"a{k}", float(o * 10 + k) if (o, k) != (2, 1) else None) for o in range(5) for k in range(3) if (o, k) != (3, 0)], "obs int, attr string, v double")
    y = spark.createDataFrame([(o, "even" if o % 2 == 0 else "odd") for o in range(1, 5)], "obs int, class string")
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("long cells on the driver"))
    wide, classes, attrs = select.to_wide(x, y)
    assert attrs == ["a0", "a1", "a2"] and classes.tolist() == ["odd", "even", "odd", "even"]
    assert wide.tolist() == [[10, 11, 12], [20, 0, 22], [0, 31, 32], [40, 41, 42]]
    with pytest.raises(Exception, match="two cells"):
        select.to_wide(x.union(x), y)
