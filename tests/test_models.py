"""Components, lineages, differential abundance and the whole feature search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import components, differential, matrix, select


def test_components(spark):
    taxa = spark.createDataFrame([("g1", "T"), ("g2", "T"), ("g3", "U")], "gene string, taxon string")
    functions = spark.createDataFrame([("g1", "f"), ("g1", "h"), ("g2", "f"), ("g3", None)], "gene string, function string")
    members = components.assign(taxa, functions)
    assert {r.component for r in members.collect()} == {"T|f", "T|h", "U|unknown_function_collective"}
    x = spark.createDataFrame([("o", "g1", 2.0), ("o", "g2", 3.0), ("o", "g3", 1.0)], "obs string, attr string, v double")
    assert {r.attr: r.v for r in components.component_counts(x, members).collect()} == {"T|f": 5.0, "T|h": 2.0, "U|unknown_function_collective": 1.0}
    lengths = spark.createDataFrame([("g1", 10), ("g2", 20), ("g3", 5)], "gene string, length int")
    rows = components.component_metadata(members, lengths).collect()
    assert rows[0].component == "T|f" and rows[0].mean == 15 and rows[0].var == 25


def test_lineage(spark):
    taxonomy = spark.createDataFrame([(1, None, "root", "root"), (2, 1, "Bacteria", "domain"), (3, 2, "Ecoli", "species")], "taxon_id int, parent int, name string, rank string")
    got = {r.taxon_id: r for r in components.lineage(spark.createDataFrame([(3,), (9,)], "taxon_id int"), taxonomy, ["domain", "species"]).collect()}
    assert (got[3].domain, got[3].species) == ("Bacteria", "Ecoli") and got[9].domain is None


def test_symmetry(spark):
    x = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "obs string, attr string, v double")
    assert matrix.is_symmetric(x) and not matrix.is_symmetric(x.where("obs = 'a'")) and matrix.prepend_level(x, "k", 1).columns[0] == "k"


@pytest.mark.parametrize("method", ["clr", "exact", "lrt"])
def test_differential_abundance(spark, method):
    rng = np.random.RandomState(0)
    rows = [(o, f"a{a:02d}", float(rng.negative_binomial(5, 5 / (5 + 100 * (6 if a == 0 and o >= 8 else 1))))) for o in range(16) for a in range(12)]
    x = spark.createDataFrame(rows, "obs int, attr string, v double")
    y = spark.createDataFrame([(o, "case" if o >= 8 else "ref") for o in range(16)], "obs int, class string")
    out = differential.differential_abundance(x, y, "ref", method)
    p = "we_p" if method == "clr" else "p_value"
    best = out.orderBy(p).head()
    assert best.attr == "a00" and out.count() == 12 and out.where(F.col(p).between(0, 1)).count() == 12
    with pytest.raises(ValueError):
        differential.differential_abundance(x, y.where("obs > 0"), "ref", method)


def test_whole_search(spark):
    rng = np.random.RandomState(0)
    x = spark.createDataFrame([(i, f"f{j}", float(rng.normal() + (3 * (i % 2) if j == 0 else 0))) for i in range(40) for j in range(5)], "obs int, attr string, v double")
    y = spark.createDataFrame([(i, str(i % 2)) for i in range(40)], "obs int, class string")
    out = select.run_selection(x, y, ("logistic",), (0.0, 0.5), (0.0,), 2, 4, params={"logistic": [{"c": 1.0, "penalty": "l2"}]})
    best = select.best_synopsis(out).head()
    assert out.count() == 2 and "f0" in best.features and best.accuracy > 0.85


def test_submodels(spark):
    x = spark.createDataFrame([(i, "a", float(i % 2 * 4)) for i in range(20)], "obs int, attr string, v double")
    targets = spark.createDataFrame([(i, "root", "odd" if i % 2 else "even") for i in range(20)], "obs int, submodel string, child string")
    edges = select.fit_submodels(x, targets, spark.createDataFrame([("root", "a")], "submodel string, attr string"))
    got = {r.obs: r.node for r in select.descend(edges, "root").collect()}
    assert all(got[i] == ("odd" if i % 2 else "even") for i in range(20))


def test_tree_tools(spark):
    import pandas as pd

    from tessera.operators import tree

    t = tree.parse_newick("((a:1,b:2,c:1):1,d:3);")
    assert tree.polytomies(spark.createDataFrame(t)).head().children == 3
    two = tree.bifurcating(t)
    assert two[two.parent.notna()].groupby("parent").size().max() == 2 and set(two.node[two.is_leaf]) == set("abcd")
    p = tree.prune(t, {"a", "d"})
    got = {r.node: (r.parent, r.length) for r in p.itertuples()}
    assert set(got) == {"y1", "a", "d"} and got["a"][1] == 2 and got["d"][1] == 3
    z = tree.linkage(np.array([[0, 1, 4], [1, 0, 4], [4, 4, 0]], float), "average")
    e = tree.edges_of(z, list("abc"))
    assert isinstance(e, pd.DataFrame) and e.set_index("node").length["c"] == 2 and e.parent.isna().sum() == 1


def test_topology_and_fits(spark):
    from tessera.operators import network, regress, tree

    rng = np.random.RandomState(0)
    base = {"x": rng.normal(size=6), "y": rng.normal(size=6)}
    base["z"] = base["x"] + 0.1 * rng.normal(size=6)
    x = spark.createDataFrame([(f"{c}{i}", f"f{j}", float(base[c][j] * (1 + i / 10))) for c in base for i in range(4) for j in range(6)], "obs string, attr string, v double")
    y = spark.createDataFrame([(f"{c}{i}", c) for c in base for i in range(4)], "obs string, class string")
    t = tree.topology(x, y)
    assert t[t.node == "x"].parent.iloc[0] == t[t.node == "z"].parent.iloc[0]
    k = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.pareto(2, 300) + 1)], "node int, k double")
    r = network.scale_free(k).head()
    assert r.slope < 0 and 0 <= r.r2 <= r.r2_truncated + 1e-9 <= 1 + 1e-9 and r.bic > -1e9
    a = spark.createDataFrame([("a", f"b{i}", float(i)) for i in range(10)], "node_a string, node_b string, weight double")
    axes = spark.createDataFrame([(f"b{i}", "B") for i in range(10)], "node string, axis string")
    assert network.compare_axes(a, a.withColumn("weight", F.col("weight") + 50), axes).where("node = 'a'").head().p_value < 0.01
    cells = spark.createDataFrame([(i, "m", 2.0 * i + 1) for i in range(9)], "obs int, attr string, v double")
    meta = spark.createDataFrame([(i, float(i)) for i in range(9)], "obs int, u double")
    left = regress.residuals(cells, regress.predict(regress.glm(cells, meta, ["u"]), meta, ["u"]))
    assert left.where("abs(residual) > 1e-9").isEmpty()


def test_collections(spark):
    from tessera.functions import collections as C

    df = spark.sql("select map('a', 1, 'b', 2) m, array('a', 'c') ks, array('a') s")
    r = df.select(C.map_reverse(F.col("m")).alias("rev"), C.map_keep(F.col("m"), F.col("ks")).alias("keep"), C.map_fill(F.col("m"), F.col("ks"), 0).alias("fill"), C.intersection(F.col("ks"), F.col("s")).alias("i"), C.is_subset(F.col("s"), F.col("ks")).alias("sub"), C.union(F.col("ks"), F.col("s")).alias("u")).head()
    assert r.rev == {1: "a", 2: "b"} and r.keep == {"a": 1} and r.fill == {"a": 1, "b": 2, "c": 0} and r.i == ["a"] and r["sub"] and r.u == ["a", "c"]
    assert C.map_expand(df.select("m"), "m").count() == 2
    assert C.both_known(spark.createDataFrame([(1.0, None), (float("nan"), 1.0), (1.0, 2.0)], "a double, b double"), "a", "b").count() == 1


def test_database_folder(spark, tmp_path):
    from tessera.operators import diversity
    from tessera.sources import readers

    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert readers.database(spark, str(tmp_path)) == ["t"] and readers.database(spark, str(tmp_path), "t").count() == 3
    x = spark.createDataFrame([("o", "a", 10.0), ("z", "a", 0.0)], "obs string, attr string, v double")
    assert [tuple(r) for r in diversity.compositional_table(x).collect()] == [("o", 1.0, 1, 0.0)]


def test_blocks_equal_long_form(spark):
    from tessera.operators import blocks, network

    rng = np.random.RandomState(0)
    m = rng.normal(size=(40, 5))
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "node int, vec array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    a = ((1 + u @ u.T) / 2) ** 2
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(40) for j in range(i + 1, 40)], "node_a int, node_b int, weight double")
    want = {(r.node_a, r.node_b): r.weight for r in network.topological_overlap(edges).collect()}
    got = {(r.node_a, r.node_b): r.weight for r in blocks.topological_overlap(blocks.similarity_tiles(blocks.row_blocks(vectors, 16), 2.0)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_overlap_of_vectors_sends_no_tiles(spark):
    from __spark_entry__ import SMOKE, queries
    from tessera.operators import blocks

    rng = np.random.RandomState(1)
    vectors = spark.createDataFrame([(f"n{i}", [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(40, 5)))], "node string, vec array<double>")
    for power in (3.0, 1.5):
        want = {(r.node_a, r.node_b): r.weight for r in blocks.topological_overlap(blocks.similarity_tiles(blocks.row_blocks(vectors, 16), power)).collect()}
        got = {(r.node_a, r.node_b): r.weight for r in blocks.similarity_overlap(vectors, power, 16).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert blocks.similarity_overlap(vectors.limit(1)).count() == 0
    with pytest.raises(ValueError):
        blocks.similarity_overlap(vectors.withColumn("vec", F.when(F.col("node") != "n3", F.col("vec"))))
    assert "Join" not in queries()["g03_tom_blocks"](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()


def test_overlap_of_copies_and_shares_of_its_work(spark):
    import duckdb

    from __spark_entry__ import SMOKE, queries
    from tessera.operators import blocks

    found = queries()["g03_tom_blocks"](spark, SMOKE)
    assert found.rdd.getNumPartitions() > 1 and "round(" not in found._jdf.queryExecution().executedPlan().toString()
    rng = np.random.RandomState(2)
    different = rng.normal(size=(30, 4))
    m = np.vstack([different, different[:20], np.repeat(different[:1], 30, axis=0), -different[:1]])
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "node int, vec array<double>")
    unit = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    for power in (1, 2.5, 6, 7.0):
        a = ((1 + np.clip(unit @ unit.T, -1, 1)) / 2) ** power
        np.fill_diagonal(a, 0)
        k = a.sum(axis=1)
        want = (a @ a + a) / (np.minimum.outer(k, k) + 1 - a)
        for size in (None, 7):
            got = {(r.node_a, r.node_b): r.weight for r in blocks.similarity_overlap(vectors, power, size).collect()}
            assert got.keys() == {(i, j) for j in range(len(m)) for i in range(j)} and all(abs(v - want[at]) < 1e-12 for at, v in got.items())
    whole = blocks.similarity_overlap(vectors, 6.0)
    got = {(r.node_a, r.node_b): r.weight for r in blocks.similarity_overlap(vectors, 6.0, digits=3).collect()}
    assert got == {(r.node_a, r.node_b): duckdb.execute("select round(?::double, 3) + 0.0", [r.weight]).fetchone()[0] for r in whole.collect()}
    values = np.concatenate([np.arange(1, 4000) / 2e6, np.nextafter(np.arange(1, 4000) / 2e6, 0), [0.0, 0.5, 1.0]])
    assert blocks._rounded(values, 6).tolist() == [r[0] for r in duckdb.execute("select round(v, 6) from (select unnest(?::double[]) as v)", [values.tolist()]).fetchall()]
    assert [blocks._pair(p) for p in range(6)] == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]


@pytest.mark.parametrize("method", ["bonferroni", "holm", "simes-hochberg", "fdr_bh"])
def test_many_p_values(spark, method):
    from tessera.operators import stats

    rng = np.random.RandomState(0)
    p = [None if i % 50 == 0 else float(round(v, 2)) for i, v in enumerate(rng.uniform(size=400) ** 3)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p_value double")
    a = {r.i: r.q_value for r in stats.p_adjust(df, method=method).collect()}
    b = {r.i: r.q_value for r in stats.p_adjust_many(df, method=method).collect()}
    assert a.keys() == b.keys() and all(a[i] == b[i] or abs(a[i] - b[i]) < 1e-12 for i in a)
