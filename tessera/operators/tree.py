"""Trees: merge tables (``step``, ``left``, ``right``, ``height``, ``size``), parent tables and Newick text.

Linkage is a loop over one small matrix and runs on the driver, up to ``LIMIT`` leaves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept

LIMIT = 5000


def square(edges: DataFrame) -> tuple[list, np.ndarray]:
    """Labels and the symmetric matrix of a small edge list."""
    rows = edges.select("node_a", "node_b", "weight").limit(LIMIT * LIMIT).toPandas()
    labels = sorted(set(rows.node_a) | set(rows.node_b))
    if len(labels) > LIMIT:
        raise ValueError(f"more than {LIMIT} leaves")
    at = {x: i for i, x in enumerate(labels)}
    m = np.zeros((len(labels), len(labels)))
    i, j = rows.node_a.map(at), rows.node_b.map(at)
    m[i, j] = m[j, i] = rows.weight
    return labels, m


def linkage(distances: np.ndarray, method: str = "ward") -> np.ndarray:
    """Lance-Williams agglomeration: rows (left, right, height, size), lesser node first."""
    n = len(distances)
    d = distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(n)), np.ones(n), []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        h, ni, nj = d[i, j], size[i], size[j]
        a, b = sorted((name[i], name[j]))
        out.append((a, b, h, ni + nj))
        di, dj, nk = d[i], d[j], size
        with np.errstate(invalid="ignore"):
            new = {
                "single": lambda: np.minimum(di, dj),
                "complete": lambda: np.maximum(di, dj),
                "average": lambda: (ni * di + nj * dj) / (ni + nj),
                "weighted": lambda: (di + dj) / 2,
                "ward": lambda: np.sqrt(np.maximum(0, ((ni + nk) * di**2 + (nj + nk) * dj**2 - nk * h**2) / (ni + nj + nk))),
            }[method]()
        new[np.isinf(di) | np.isinf(dj)] = np.inf
        d[i] = d[:, i] = new
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        name[i], size[i] = n + step, ni + nj
    return np.array(out).reshape(-1, 4)


def merge_table(edges: DataFrame, method: str = "ward") -> tuple[list, DataFrame]:
    labels, m = square(edges)
    z = linkage(m, method)
    rows = [(k, int(a), int(b), float(h), int(s)) for k, (a, b, h, s) in enumerate(z)]
    return labels, edges.sparkSession.createDataFrame(rows, "step int, left int, right int, height double, size int")


def newick(z: np.ndarray, labels: list) -> str:
    """Newick text; a branch is half the difference of heights."""
    n = len(labels)
    text = {i: str(x) for i, x in enumerate(labels)}
    height = dict.fromkeys(range(n), 0.0)
    for k, (a, b, h, _) in enumerate(z):
        text[n + k] = "(" + ",".join(f"{text.pop(int(c))}:{(h - height[int(c)]) / 2:.10g}" for c in (a, b)) + ")"
        height[n + k] = h
    return next(iter(text.values())) + ";"


def parse_newick(text: str) -> pd.DataFrame:
    """Parent table (``node``, ``parent``, ``length``, ``is_leaf``); unnamed inner nodes are y1, y2, ... in preorder."""
    rows, stack, pos, text = [], [None], 0, text.strip().rstrip(";")

    def add(parent):
        rows.append({"id": len(rows), "parent": parent, "name": "", "length": None, "is_leaf": True})
        return len(rows) - 1

    current = add(None)
    while pos < len(text):
        c = text[pos]
        if c == "(":
            rows[current]["is_leaf"] = False
            stack.append(current)
            current = add(current)
        elif c == ",":
            current = add(stack[-1])
        elif c == ")":
            current = stack.pop()
        else:
            end = pos
            while end < len(text) and text[end] not in "(),":
                end += 1
            label, _, length = text[pos:end].partition(":")
            rows[current]["name"] = label.strip()
            rows[current]["length"] = float(length) if length else None
            pos = end - 1
        pos += 1
    out, inner = pd.DataFrame(rows), 0
    names = []
    for r in out.itertuples():
        if not r.is_leaf and not r.name:
            inner += 1
            names.append(f"y{inner}")
        else:
            names.append(r.name)
    out["node"] = names
    return pd.DataFrame({"node": out.node, "parent": [names[int(p)] if pd.notna(p) else None for p in out.parent], "length": out.length, "is_leaf": out.is_leaf})


def ancestors(tree: DataFrame) -> DataFrame:
    """Every node with itself and all ancestors: ``node``, ``ancestor``, ``steps``, ``distance``; by pointers that double, so depth costs its logarithm."""
    zero = F.lit(0.0)
    found = kept(tree.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps"), zero.alias("distance")))
    jump = kept(tree.where("parent is not null").select("node", F.col("parent").alias("to"), F.coalesce(F.col("length").cast("double"), zero).alias("far")))
    n, reach = found.count(), 1
    while not jump.isEmpty():
        if reach > n:
            raise ValueError("a node is its own ancestor")
        on = jump.select(F.col("node").alias("ancestor"), "to", "far")
        found = kept(found.unionByName(found.join(on, "ancestor").select("node", F.col("to").alias("ancestor"), (F.col("steps") + reach).alias("steps"), (F.col("distance") + F.col("far")).alias("distance"))))
        jump = kept(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("far").alias("__far")), "to").select("node", F.col("__to").alias("to"), (F.col("far") + F.col("__far")).alias("far")))
        reach *= 2
    return found


def leaf_distances(tree: DataFrame, topology_only: bool = True) -> DataFrame:
    """Path length (or number of inner nodes between) of all pairs of leaves, over their lowest common ancestor."""
    up = ancestors(tree).join(tree.where("is_leaf").select("node"), "node", "left_semi")
    a = up.select(F.col("node").alias("node_a"), "ancestor", F.col("steps").alias("sa"), F.col("distance").alias("da"))
    b = up.select(F.col("node").alias("node_b"), "ancestor", F.col("steps").alias("sb"), F.col("distance").alias("db"))
    pairs = a.join(b, "ancestor").where("node_a < node_b")
    low = pairs.groupBy("node_a", "node_b").agg(F.min(F.struct((F.col("sa") + F.col("sb")).alias("s"), (F.col("da") + F.col("db")).alias("d"))).alias("m"))
    return low.select("node_a", "node_b", (F.col("m.s") - 1 if topology_only else F.col("m.d")).cast("double").alias("weight"))


def cut(z: np.ndarray, height: float, min_size: int = 3) -> np.ndarray:
    """Clusters of leaves joined at or below a height: numbered from the largest, smaller than ``min_size`` are -1."""
    n = len(z) + 1
    root = list(range(n + len(z)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (a, b, h, _) in enumerate(z):
        if h <= height:
            root[find(int(a))] = n + k
            root[find(int(b))] = n + k
    group = pd.Series([find(i) for i in range(n)])
    counts = group.value_counts(sort=False)
    first = group.drop_duplicates().reset_index().set_index(0)["index"]
    order = sorted(counts.index, key=lambda c: (-counts[c], first[c]))
    number = {c: k if counts[c] >= min_size else -1 for k, c in enumerate(order)}
    return group.map(number).to_numpy()


#: Greatest scatter of a cluster's core for each depth of splitting (fixed values of the published method).
SCATTER = (0.64, 0.73, 0.82, 0.91, 0.95)


def _core(size: int, min_size: int) -> int:
    base = min_size / 2 + 1
    return int(base + math.sqrt(size - base)) if base < size else size


def hybrid_cut(z: np.ndarray, distances: np.ndarray, min_size: int = 20, deep_split: int = 2, height: float | None = None, assign: bool = True) -> np.ndarray:
    """Clusters by the published hybrid method of dynamic tree cutting, numbered from the largest; outliers are -1.

    Merges are followed upwards.  Where two branches meet, each is a cluster if
    it has ``min_size`` leaves, a tight core (its earliest leaves, by mean
    distance) and a gap between the core's scatter and the merge; if one is not,
    they become one branch.  With ``assign``, leaves left over join the cluster
    of least mean distance, if that is within the cluster's own radius or the cut.
    """
    n = len(z) + 1
    heights = z[:, 2]
    if not len(heights):
        return np.full(n, 0 if min_size <= 1 else -1)
    low = float(np.sort(heights)[max(0, round(len(heights) * 0.05) - 1)])
    height = 0.99 * (float(heights.max()) - low) + low if height is None else height
    scatter = low + SCATTER[deep_split] * (height - low)
    gap = (1 - SCATTER[deep_split]) * 0.75 * (height - low)
    branch: dict[int, tuple[list[int], list[list[int]]]] = {}  # node: its own leaves in order, and the clusters fixed inside it

    def good(leaves: list[int], at: float) -> bool:
        if len(leaves) < min_size:
            return False
        core = leaves[: _core(len(leaves), min_size)]
        spread = distances[np.ix_(core, core)].sum() / (len(core) * max(1, len(core) - 1))
        return spread <= scatter and at - spread >= gap

    for k, (a, b, h, _) in enumerate(z):
        if h > height:
            continue
        one, two = ((([int(c)], []) if c < n else branch.pop(int(c))) for c in (a, b))
        if one[1] and two[1]:
            joined = ([*one[0], *two[0]], [*one[1], *two[1]])
        elif one[1] or two[1]:
            fixed, plain = (one, two) if one[1] else (two, one)
            joined = (fixed[0], [*fixed[1], plain[0]]) if good(plain[0], h) else ([*fixed[0], *plain[0]], fixed[1])
        elif good(one[0], h) and good(two[0], h):
            joined = ([], [one[0], two[0]])
        else:
            large, small = (one, two) if len(one[0]) >= len(two[0]) else (two, one)
            joined = ([*large[0], *small[0]], [])
        branch[n + k] = joined
    found: list[list[int]] = []
    for own, fixed in branch.values():
        found += fixed or ([own] if good(own, height) else [])
    label = np.full(n, -1)
    for i, leaves in enumerate(sorted(found, key=lambda c: (-len(c), min(c)))):
        label[leaves] = i
    if assign and found:
        count = label.max() + 1
        mean = np.stack([distances[:, label == c].mean(axis=1) for c in range(count)], axis=1)
        radius = np.array([mean[label == c, c].max() for c in range(count)])
        for i in np.flatnonzero(label == -1):
            c = int(mean[i].argmin())
            if mean[i, c] <= max(radius[c], height):
                label[i] = c
        sizes = np.bincount(label[label >= 0], minlength=count)
        number = np.empty(count, int)
        number[np.argsort(-sizes, kind="stable")] = np.arange(count)
        label = np.where(label >= 0, number[label], -1)
    return label


def clusters(edges: DataFrame, method: str = "ward", cut_method: str = "hybrid", min_size: int = 3, deep_split: int = 2, height: float | None = None) -> DataFrame:
    """``node``, ``cluster`` of a small distance network by a cut of its linkage; a ``static`` cut needs a height."""
    labels, m = square(edges)
    z = linkage(m, method)
    if cut_method == "static" and height is None:
        raise ValueError("a static cut needs a height")
    found = cut(z, height, min_size) if cut_method == "static" else hybrid_cut(z, m, min_size, deep_split, height)
    return edges.sparkSession.createDataFrame([(v, int(c)) for v, c in zip(labels, found, strict=True)], f"node {dict(edges.dtypes)['node_a']}, cluster int")


def with_track(leaves: DataFrame, track: DataFrame, name: str, fill=None) -> DataFrame:
    """The table of leaves (``node``) with a column of values or classes (``node``, ``v``); leaves without one get ``fill``, others than leaves are an error."""
    strange = track.join(leaves, "node", "left_anti").limit(1).collect()
    if strange:
        raise ValueError(f"not a leaf: {strange[0].node!r}")
    out = leaves.join(track.select("node", F.col("v").alias(name)), "node", "left")
    return out if fill is None else out.fillna(fill, [name])


def eigengenes(x: DataFrame, clusters: DataFrame) -> DataFrame:
    """First principal component of each cluster of attributes over the observations, with its share of variance."""
    rows = x.join(clusters.select(F.col("node").alias("attr"), "cluster"), "attr")
    kind = dict(x.dtypes)["obs"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = g.pivot(index="obs", columns="attr", values="v").fillna(0.0).sort_index()
        c = m.to_numpy() - m.to_numpy().mean(axis=0)
        u, s, vt = np.linalg.svd(c, full_matrices=False)
        sign = np.sign(vt[0][np.abs(vt[0]).argmax()]) or 1.0
        total = (s**2).sum()
        return pd.DataFrame({"cluster": g.cluster.iloc[0], "obs": m.index, "v": u[:, 0] * s[0] * sign, "explained": s[0] ** 2 / total if total else 0.0})

    return rows.groupBy("cluster").applyInPandas(run, f"cluster {dict(clusters.dtypes)['cluster']}, obs {kind}, v double, explained double")


def target_matrix(tree: DataFrame, y: DataFrame) -> DataFrame:
    """For each observation and each inner node above its class: the child towards the class (``obs``, ``submodel``, ``child``)."""
    up = ancestors(tree)
    step = up.where("steps > 0").select(F.col("node").alias("class"), F.col("ancestor").alias("submodel"), "steps")
    below = up.select(F.col("node").alias("class"), F.col("ancestor").alias("child"), (F.col("steps") + 1).alias("steps"))
    return y.join(step, "class").join(below, ["class", "steps"]).select("obs", "submodel", "child")


def silhouette(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean distance inside and to other clusters of every node, and (inter - intra) / max of both."""
    both = edges.select("node_a", "node_b", "weight").unionByName(edges.select(F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b"), "weight"))
    a = clusters.select(F.col("node").alias("node_a"), F.col("cluster").alias("ca"))
    b = clusters.select(F.col("node").alias("node_b"), F.col("cluster").alias("cb"))
    means = both.join(a, "node_a").join(b, "node_b").groupBy("node_a", "ca", "cb").agg(F.avg("weight").alias("d"))
    s = means.groupBy(F.col("node_a").alias("node"), F.col("ca").alias("cluster")).agg(F.max(F.when(F.col("ca") == F.col("cb"), F.col("d"))).alias("intra"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("d"))).alias("inter"))
    return s.withColumn("silhouette", F.try_divide(F.col("inter") - F.col("intra"), F.greatest("inter", "intra")))


def by_size(clusters: DataFrame) -> DataFrame:
    """Clusters renumbered from the largest."""
    n = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return clusters.join(n.withColumn("number", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")) - 1), "cluster").select("node", F.col("number").alias("cluster"))


def edges_of(z: np.ndarray, labels: list) -> pd.DataFrame:
    """Parent table of a linkage, inner nodes named y1, y2, ... in merge order; a branch is half the difference of heights."""
    n, name = len(labels), [str(x) for x in labels] + [f"y{k + 1}" for k in range(len(z))]
    height = [0.0] * n + [float(r[2]) for r in z]
    rows = [(name[int(c)], name[n + k], (height[n + k] - height[int(c)]) / 2, int(c) < n) for k, r in enumerate(z) for c in r[:2]]
    return pd.DataFrame([*rows, (name[-1], None, None, n == 1)], columns=["node", "parent", "length", "is_leaf"])


def polytomies(tree: DataFrame) -> DataFrame:
    """Nodes with more than two children."""
    return tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children")).where("children > 2")


def prune(tree: pd.DataFrame, leaves: set) -> pd.DataFrame:
    """The tree of some leaves: other leaves go, and inner nodes with one child are joined to it, lengths added."""
    parent, length = dict(zip(tree.node, tree.parent, strict=True)), dict(zip(tree.node, tree.length, strict=True))
    keep: set = set()
    for leaf in leaves & set(tree.node[tree.is_leaf]):
        while leaf is not None and leaf == leaf and leaf not in keep:
            keep.add(leaf)
            leaf = parent[leaf]
    children: dict = {}
    for n in keep:
        children.setdefault(parent[n], []).append(n)
    rows = []

    def walk(n, above, extra):
        while len(children.get(n, [])) == 1:
            n = children[n][0]
            extra += length[n] if length[n] == length[n] and length[n] is not None else 0.0
        rows.append((n, above, None if above is None else extra, n not in children))
        for c in children.get(n, []):
            walk(c, n, length[c] if length[c] == length[c] and length[c] is not None else 0.0)

    for n in keep:
        if parent[n] is None or parent[n] != parent[n]:
            walk(n, None, 0.0)
    return pd.DataFrame(rows, columns=["node", "parent", "length", "is_leaf"])


def bifurcating(tree: pd.DataFrame) -> pd.DataFrame:
    """Nodes with more than two children as chains of nodes with two, new branches of length 0."""
    rows, kids = [], {}
    for r in tree.itertuples(index=False):
        kids.setdefault(r.parent, []).append(r)
    for parent, group in kids.items():
        at = parent
        for k, r in enumerate(group):
            last = len(group) - k <= 2 or parent is None
            rows.append((r.node, at, r.length, r.is_leaf))
            if not last:
                new = f"{parent}.{k + 1}"
                rows.append((new, at, 0.0, False))
                at = new
    return pd.DataFrame(rows, columns=["node", "parent", "length", "is_leaf"])


def topology(x: DataFrame, y: DataFrame, method: str = "ward") -> pd.DataFrame:
    """The hierarchy of classes: linkage of the distances of their eigenprofiles, as a parent table."""
    from .ordination import eigenprofiles
    from .pairs import pairwise

    profiles = eigenprofiles(x, y).select(F.col("attr").alias("obs"), F.col("class").alias("attr"), "v")
    labels, d = square(pairwise(profiles, "euclidean"))
    return edges_of(linkage(d, method), labels)
