"""Feature selection by permutation of training halves, and hierarchical classification.

The task table (iteration, hyper-parameters, half) is spread over the cluster;
the data, an observation axis by a feature axis, is broadcast up to ``CELLS``
cells.  Models are logistic regressions and decision trees in NumPy.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept

CELLS = 20_000_000


def _sigmoid(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Logistic:
    """Multinomial logistic regression with an l1 or l2 penalty, by accelerated proximal gradient."""

    def __init__(self, c: float = 1.0, penalty: str = "l2", steps: int = 200):
        self.c, self.penalty, self.steps = c, penalty, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Logistic":
        self.classes, t = np.unique(y, return_inverse=True)
        n, k = len(x), len(self.classes)
        hot = np.eye(k)[t]
        a = np.column_stack((x, np.ones(n)))
        step = 1 / (0.5 * np.linalg.norm(a, 2) ** 2 / n + 1 / (self.c * n))
        w = z = np.zeros((a.shape[1], k))
        for i in range(self.steps):
            g = a.T @ (_sigmoid(a @ z) - hot) / n
            if self.penalty == "l2":
                g[:-1] += z[:-1] / (self.c * n)
            new = z - step * g
            if self.penalty == "l1":
                new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step / (self.c * n), 0)
            z, w = new + i / (i + 3) * (new - w), new
        self.w = w
        return self

    def proba(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(np.column_stack((x, np.ones(len(x)))) @ self.w)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.proba(x).argmax(axis=1)]

    def weights(self) -> np.ndarray:
        """Class by feature."""
        return self.w[:-1].T


class Tree:
    """A CART classifier (gini or entropy); importances are decreases of impurity."""

    def __init__(self, criterion: str = "gini", min_samples_leaf: int = 1, max_features=None, seed: int = 0):
        self.criterion, self.leaf, self.features, self.seed = criterion, min_samples_leaf, max_features, seed

    def _impurity(self, c: np.ndarray) -> np.ndarray:
        p = c / np.maximum(c.sum(axis=-1, keepdims=True), 1)
        if self.criterion == "gini":
            return 1 - (p**2).sum(axis=-1)
        return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=-1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Tree":
        self.classes, t = np.unique(y, return_inverse=True)
        self.importance, rng = np.zeros(x.shape[1]), np.random.RandomState(self.seed)
        m = x.shape[1]
        k = {None: m, "sqrt": max(1, int(m**0.5)), "log2": max(1, int(np.log2(m))) if m > 1 else 1}.get(self.features, m if not isinstance(self.features, float) else max(1, int(m * self.features)))
        hot = np.eye(len(self.classes))[t]

        def grow(rows: np.ndarray):
            total = hot[rows].sum(axis=0)
            best = None
            if len(rows) >= 2 * self.leaf and (total > 0).sum() > 1:
                for f in rng.permutation(m)[:k]:
                    order = rows[np.argsort(x[rows, f], kind="stable")]
                    left = np.cumsum(hot[order], axis=0)[:-1]
                    v = x[order, f]
                    n = np.arange(1, len(rows))
                    ok = (v[1:] > v[:-1]) & (n >= self.leaf) & (len(rows) - n >= self.leaf)
                    if ok.any():
                        cost = np.where(ok, n * self._impurity(left) + (len(rows) - n) * self._impurity(total - left), np.inf)
                        i = int(cost.argmin())
                        if best is None or cost[i] < best[0]:
                            best = (cost[i], f, (v[i] + v[i + 1]) / 2)
            if best is None:
                return total / total.sum()
            cost, f, cut = best
            self.importance[f] += len(rows) * self._impurity(total) - cost
            return f, cut, grow(rows[x[rows, f] <= cut]), grow(rows[x[rows, f] > cut])

        self.root = grow(np.arange(len(x)))
        s = self.importance.sum()
        self.importance = self.importance / s if s else self.importance
        return self

    def proba(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)))
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, tuple):
                f, cut, a, b = node
                left = x[rows, f] <= cut
                todo += [(a, rows[left]), (b, rows[~left])]
            else:
                out[rows] = node
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.proba(x).argmax(axis=1)]

    def weights(self) -> np.ndarray:
        return self.importance[None]


# fixed values of the hyper-parameter spaces
STRENGTHS = np.linspace(1e-10, 1.0, 20)
PENALTIES = ("l2", "l1")
LEAVES = (1, 2, 3, 5, 8)
CRITERIA = ("gini", "entropy")
FEATURES = ("sqrt", "log2", None, 0.382)


def grid(kind: str) -> list[dict]:
    """Hyper-parameters, those preferred among equally accurate ones first: l2 and weak penalties; small leaves, gini, then the square root."""
    if kind == "logistic":
        return [{"c": float(c), "penalty": p} for p, c in itertools.product(PENALTIES, STRENGTHS[::-1])]
    return [{"criterion": c, "min_samples_leaf": n, "max_features": f} for n, c, f in itertools.product(LEAVES, CRITERIA, FEATURES)]


class Mixed:
    """Models on columns of their own, each (kind, options, columns), under a logistic regression of their out-of-fold probabilities."""

    def __init__(self, parts: list[tuple[str, dict, list[int]]], folds: int = 5, seed: int = 0, **final):
        self.parts, self.folds, self.seed, self.final = parts, folds, seed, final

    def _stack(self, models: list, x: np.ndarray) -> np.ndarray:
        out = []
        for (_, _, columns), model in zip(self.parts, models, strict=True):
            p = np.zeros((len(x), len(self.classes)))
            p[:, np.searchsorted(self.classes, model.classes)] = model.proba(x[:, columns])
            out.append(p)
        return np.hstack(out)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Mixed":
        self.classes = np.unique(y)
        fit = lambda rows: [make(kind, options).fit(x[rows][:, columns], y[rows]) for kind, options, columns in self.parts]
        fold, rng = np.empty(len(y), int), np.random.RandomState(self.seed)
        for c in self.classes:
            rows = rng.permutation(np.flatnonzero(y == c))
            fold[rows] = np.arange(len(rows)) % self.folds
        held = np.empty((len(y), len(self.parts) * len(self.classes)))
        for f in np.unique(fold):
            held[fold == f] = self._stack(fit(fold != f if (fold != f).any() else fold == f), x[fold == f])
        self.models, self.top = fit(np.ones(len(y), bool)), Logistic(**self.final).fit(held, y)
        return self

    def proba(self, x: np.ndarray) -> np.ndarray:
        return self.top.proba(self._stack(self.models, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.proba(x).argmax(axis=1)]

    def weights(self) -> np.ndarray:
        """Class by part and class."""
        return self.top.weights()


def make(kind, options: dict):
    """A model by its kind's name, or by calling ``kind`` itself: any object with fit, predict, proba, weights and classes."""
    if callable(kind):
        return kind(**options)
    return {"logistic": Logistic, "tree": Tree, "mixed": Mixed}[kind](**options)


def to_wide(x: DataFrame, y: DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
    """A dense matrix of bounded size, its classes and its attributes.

    Rows are packed on the cluster and come a partition at a time, so the driver holds the matrix alone.
    """
    cells = x.join(y, "obs")
    axis = cells.groupBy("attr").agg(F.count(F.lit(1)).alias("n")).orderBy("attr").collect()  # a row an attribute
    if sum(r.n for r in axis) > CELLS:
        raise ValueError(f"more than {CELLS} cells")
    attrs = [r.attr for r in axis]
    names = x.sparkSession.createDataFrame([(i, a) for i, a in enumerate(attrs)], f"at int, attr {dict(x.dtypes)['attr']}")
    per = cells.join(F.broadcast(names), "attr").groupBy("obs").agg(F.min("class").alias("class"), F.collect_list("at").alias("at"), F.collect_list(F.coalesce(F.col("v").cast("double"), F.lit(0.0))).alias("v"))

    def pack(batches):
        for batch in batches:
            at, v = batch.column("at"), batch.column("v")
            place = np.repeat(np.arange(len(batch)), np.diff(at.offsets.to_numpy())) * len(attrs) + at.flatten().to_numpy()
            if len(np.unique(place)) < len(place):
                raise ValueError("an observation has two cells of one attribute")
            rows = np.zeros(len(batch) * len(attrs))
            rows[place] = np.nan_to_num(v.flatten().to_numpy(), nan=0.0, posinf=np.inf, neginf=-np.inf)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("class").to_pylist()], pa.list_(batch.schema.field("class").type)), pa.array([rows.tobytes()], pa.binary())], names=["classes", "rows"])

    parts = per.orderBy("obs").mapInArrow(pack, f"classes array<{dict(y.dtypes)['class']}>, rows binary")
    classes, rows = [], []
    for r in parts.toLocalIterator():
        classes += r.classes
        rows.append(np.frombuffer(r.rows).reshape(-1, len(attrs)))
    wide = np.empty((len(classes), len(attrs)))
    at = len(wide)
    while rows:  # each part is freed once it is copied
        part = rows.pop()
        wide[at - len(part) : at] = part
        at -= len(part)
    return wide, pd.Series(classes).to_numpy(), attrs


def halves(classes: np.ndarray, seed: int) -> np.ndarray:
    """A stratified half of the observations."""
    rng, out = np.random.RandomState(seed), np.zeros(len(classes), bool)
    for c in np.unique(classes):
        rows = rng.permutation(np.flatnonzero(classes == c))
        out[rows[: (len(rows) + rng.randint(2)) // 2]] = True
    return out


def kernel(x: DataFrame, y: DataFrame, kind: str = "logistic", n_iter: int = 100, seed: int = 0, params: list[dict] | None = None) -> DataFrame:
    """Weights of every fit: ``iter``, ``param``, ``half``, ``class``, ``attr``, ``weight``, ``accuracy``."""
    spark = x.sparkSession
    m, classes, attrs = to_wide(x, y)
    params = params or grid(kind)
    shared = spark.sparkContext.broadcast((m, classes, attrs))

    def run(frames):
        m, classes, attrs = shared.value
        for f in frames:
            for r in f.itertuples():
                first = halves(classes, seed + int(r.iter))
                for half, train in ((0, first), (1, ~first)):
                    model = make(kind, params[int(r.param)]).fit(m[train], classes[train])
                    acc = float((model.predict(m[~train]) == classes[~train]).mean())
                    w = model.weights()
                    names = model.classes if len(w) > 1 else ["all"]
                    for c, row in zip(names, w, strict=True):
                        yield pd.DataFrame({"iter": int(r.iter), "param": int(r.param), "half": half, "class": str(c), "attr": [str(a) for a in attrs], "weight": row, "accuracy": acc})

    tasks = spark.range(n_iter).withColumnRenamed("id", "iter").crossJoin(spark.range(len(params)).withColumnRenamed("id", "param"))
    tasks = tasks.repartition(max(1, min(n_iter * len(params), 4 * spark.sparkContext.defaultParallelism)))
    return tasks.mapInPandas(run, "iter long, param long, half int, class string, attr string, weight double, accuracy double")


#: Thresholds of accuracy without a given one.
THRESHOLDS = tuple(float(t) for t in np.linspace(0, 0.9, 100))


def weights_by_threshold(k: DataFrame, thresholds=THRESHOLDS, func_weights=None) -> DataFrame:
    """``threshold``, ``attr``, ``weight``: absolute weights summed over fits more accurate than each threshold, as shares.

    Fits are summed once for each number of thresholds they pass, then unfolded.
    ``func_weights`` maps a column of sums before shares are taken.
    """
    steps = sorted({float(t) for t in thresholds})
    passed = F.size(F.filter(F.array(*[F.lit(t) for t in steps]), lambda t: F.col("accuracy") > t))
    sums = k.groupBy(passed.alias("n"), "attr").agg(F.sum(F.abs("weight")).alias("w")).where("n > 0")
    per = sums.select("attr", "w", F.explode(F.slice(F.array(*[F.lit(t) for t in steps]), F.lit(1), F.col("n"))).alias("threshold")).groupBy("threshold", "attr").agg(F.sum("w").alias("w"))
    w = func_weights(F.col("w")) if func_weights else F.col("w")
    return per.withColumn("w", w).select("threshold", "attr", F.try_divide("w", F.sum("w").over(Window.partitionBy("threshold"))).alias("weight"))


def weights(k: DataFrame, threshold: float | None = None, func_weights=None) -> DataFrame:
    """Normalised absolute weights of fits above a threshold; without one, summed over a hundred from 0 to 0.9."""
    total = weights_by_threshold(k, THRESHOLDS if threshold is None else (threshold,), func_weights).groupBy("attr").agg(F.sum("weight").alias("w"))
    whole = total.agg(F.sum("w").alias("all"))
    return total.crossJoin(F.broadcast(whole)).select("attr", F.try_divide("w", "all").alias("weight"))


def weights_by_class(k: DataFrame, threshold: float | None = None) -> DataFrame:
    """``class``, ``attr``, ``weight``: shares of each class's absolute weights (of logistic fits)."""
    rows = k if threshold is None else k.where(F.col("accuracy") > threshold)
    per = rows.groupBy("class", "attr").agg(F.sum(F.abs("weight")).alias("w"))
    return per.select("class", "attr", F.try_divide("w", F.sum("w").over(Window.partitionBy("class"))).alias("weight"))


def extract_weights(k: DataFrame, mode: int = 0, threshold: float | None = None, func_weights=None) -> DataFrame:
    """Weights by mode: 0 at a threshold, 1 at each of a hundred, 2 over all of those, 3 by class; 0 without a threshold is 2."""
    if mode == 0 or mode == 2:
        return weights(k, threshold if mode == 0 else None, func_weights)
    if mode == 1:
        return weights_by_threshold(k, THRESHOLDS if threshold is None else (*THRESHOLDS, threshold), func_weights)
    if mode == 3:
        return weights_by_class(k, threshold)
    raise ValueError(f"unknown mode {mode!r}")


def best_params(k: DataFrame) -> DataFrame:
    """Mean accuracy of each hyper-parameter set, the best first."""
    return k.select("iter", "param", "half", "accuracy").distinct().groupBy("param").agg(F.avg("accuracy").alias("accuracy")).orderBy(F.desc("accuracy"), "param")


def sizes(m: int, method: str = "bruteforce", bounds=(0, 0.5, 1.0), steps=(1, 10)) -> list[int]:
    """Numbers of leading features that a sweep tries: all below m, or steps that widen by stretches of the order."""
    if method == "bruteforce":
        return list(range(1, max(2, m)))
    if method != "adaptive":
        raise ValueError(f"unknown method {method!r}")
    ends = [int(b * m) for b in bounds]
    return sorted({n for lo, hi, step in zip(ends, ends[1:], steps, strict=False) for n in range(lo, hi, step)} - {0})


def cross_validate(x: DataFrame, y: DataFrame, ordered: list, kind: str = "logistic", options: dict | None = None, folds: int = 10, seed: int = 0, method: str = "bruteforce", bounds=(0, 0.5, 1.0), steps=(1, 10)) -> DataFrame:
    """Accuracy and its standard error for the leading features of an order, as many as ``sizes`` says."""
    spark = x.sparkSession
    m, classes, attrs = to_wide(x, y)
    place = {str(a): i for i, a in enumerate(attrs)}
    cols = [place[str(a)] for a in ordered]
    rng = np.random.RandomState(seed)
    fold = np.empty(len(classes), int)
    for c in np.unique(classes):
        rows = rng.permutation(np.flatnonzero(classes == c))
        fold[rows] = np.arange(len(rows)) % folds
    shared = spark.sparkContext.broadcast((m, classes, fold))

    def run(frames):
        m, classes, fold = shared.value
        for f in frames:
            for n in f.n:
                part = m[:, cols[: int(n)]]
                acc = [float((make(kind, options or {}).fit(part[fold != k], classes[fold != k]).predict(part[fold == k]) == classes[fold == k]).mean()) for k in range(folds) if (fold == k).any()]
                yield pd.DataFrame({"n": [int(n)], "accuracy": [np.mean(acc)], "sem": [np.std(acc, ddof=1) / np.sqrt(len(acc))], "features": [[str(ordered[i]) for i in range(int(n))]]})

    tried = spark.createDataFrame([(n,) for n in sizes(len(ordered), method, bounds, steps)], "n long")
    return tried.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "n long, accuracy double, sem double, features array<string>")


def until_stale(scores: DataFrame, patience: int = 100) -> DataFrame:
    """Scores up to where ``patience`` in a row have not improved the best."""
    w = Window.orderBy("n")
    rows = scores.withColumn("best", F.max("accuracy").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("last", F.max(F.when(F.col("best").isNull() | (F.col("accuracy") > F.col("best")), F.col("n"))).over(w))
    return rows.where(F.col("n") - F.col("last") <= patience).select(*scores.columns)


def best_model(scores: DataFrame) -> DataFrame:
    """Highest accuracy, then least error, then fewest features."""
    return scores.orderBy(F.desc("accuracy"), "sem", "n").limit(1)


def progressive(scores: DataFrame) -> DataFrame:
    """Rows that set a record."""
    before = F.max("accuracy").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return scores.withColumn("before", before).where("before is null or accuracy > before").drop("before")


def run_selection(x: DataFrame, y: DataFrame, kinds=("logistic", "tree"), percentiles=(0.0, 0.3, 0.5, 0.75, 0.9), thresholds=(None, 0.0), n_iter: int = 10, folds: int = 10, patience: int = 100, seed: int = 0, params: dict | None = None) -> DataFrame:
    """The whole search: per model kind, ever smaller shares of the leading features are weighed and swept; one row a sweep.

    Each percentile keeps ``round((1 - p) * m)`` (half to even) leading features
    of the last weights.  Thresholds that weigh features alike are swept once.
    """
    spark, out = x.sparkSession, []
    for kind in kinds:
        options = (params or {}).get(kind) or grid(kind)
        names = [r.attr for r in x.select("attr").distinct().orderBy("attr").collect()]
        m, last = len(names), None
        for p in percentiles:
            if last is not None:
                names = last[: max(2, round((1 - p) * m))]
            keep = spark.createDataFrame([(n,) for n in names], f"attr {dict(x.dtypes)['attr']}")
            part = x.join(F.broadcast(keep), "attr", "left_semi")
            k = kept(kernel(part, y, kind, n_iter, seed, options))
            best = best_params(k).head()
            done: list[list] = []
            for t in thresholds:
                rows = weights(k, t).where("weight > 0").orderBy(F.desc("weight"), "attr").collect()
                by_text = {str(n): n for n in names}
                order = [by_text[r.attr] for r in rows]
                if len(order) < 2 or order in done:
                    continue
                done.append(order)
                scores = until_stale(cross_validate(part, y, order, kind, options[best.param], folds, seed), patience)
                r = best_model(scores).head()
                out.append((kind, float(p), t, float(best.accuracy), float(r.accuracy), float(r.sem), int(r.n), [str(f) for f in r.features]))
            if done:
                last = done[0] + [n for n in names if n not in done[0]]
    return spark.createDataFrame(out, "kind string, percentile double, threshold double, baseline double, accuracy double, sem double, n long, features array<string>")


def best_synopsis(synopsis: DataFrame, prefer: str = "logistic") -> DataFrame:
    """The best row over kinds: accuracy, then error, then size, then the preferred kind."""
    return synopsis.orderBy(F.desc("accuracy"), "sem", "n", F.col("kind") != prefer).limit(1)


def fit_submodels(x: DataFrame, targets: DataFrame, attributes: DataFrame, kind="logistic", options: dict | None = None, apply_to: DataFrame | None = None) -> DataFrame:
    """Edge probabilities of a hierarchy: every submodel is fitted on its own observations (``obs``, ``submodel``, ``child``) and attributes, and applied to all (or to other cells)."""
    models = {}
    for r in targets.select("submodel").distinct().collect():
        cells = x.join(attributes.where(F.col("submodel") == r.submodel).select("attr"), "attr", "left_semi")
        m, classes, attrs = to_wide(cells, targets.where(F.col("submodel") == r.submodel).select("obs", F.col("child").alias("class")))
        models[r.submodel] = (make(kind, options or {}).fit(m, classes), attrs)
    key = dict(x.dtypes)["obs"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        values, rows = dict(zip(g.attr, g.v, strict=True)), []
        for name, (model, attrs) in models.items():
            p = model.proba(np.array([[values.get(a, 0.0) for a in attrs]]))[0]
            rows += [(g.obs.iloc[0], name, str(c), float(v)) for c, v in zip(model.classes, p, strict=True)]
        return pd.DataFrame(rows, columns=["obs", "parent", "child", "p"])

    return (x if apply_to is None else apply_to).groupBy("obs").applyInPandas(run, f"obs {key}, parent string, child string, p double")


def path_probabilities(edges: DataFrame, paths: DataFrame, how="tss") -> DataFrame:
    """Products of edge probabilities (``obs``, ``parent``, ``child``, ``p``) along each target's path (``target``, ``parent``, ``child``), normalised by observation: ``tss``, ``softmax`` or a function of a column and a window."""
    rows = edges.join(paths, ["parent", "child"]).groupBy("obs", "target").agg(F.product("p").alias("p"))
    w = Window.partitionBy("obs")
    if callable(how):
        return rows.withColumn("p", how(F.col("p"), w))
    v = {"tss": F.col("p"), "softmax": F.exp("p")}[how]
    return rows.withColumn("p", F.try_divide(v, F.sum(v).over(w)))


def components(edges: DataFrame) -> DataFrame:
    """Each submodel's own likeliest child of each observation: ``obs``, ``submodel``, ``child``; the least of equals."""
    return edges.groupBy("obs", F.col("parent").alias("submodel")).agg(F.min(F.struct((-F.col("p")).alias("o"), "child")).alias("s")).select("obs", "submodel", "s.child")


def predict(edges: DataFrame, paths: DataFrame, mode: str = "directional", how="tss") -> DataFrame:
    """Classes from edge probabilities: ``component`` (each submodel's), ``directional`` (followed from the root that all paths share) or ``diffuse`` (the likeliest whole path)."""
    if mode == "component":
        return components(edges)
    if mode == "diffuse":
        return most_likely(path_probabilities(edges, paths, how))
    if mode != "directional":
        raise ValueError(f"unknown mode {mode!r}")
    roots = [r[0] for r in paths.select("parent").distinct().join(paths.select(F.col("child").alias("parent")), "parent", "left_anti").limit(2).collect()]
    if len(roots) != 1:
        raise ValueError("paths must share one root")
    return descend(edges, roots[0]).withColumnRenamed("node", "target")


def cumulative_weights(paths: DataFrame, weight: DataFrame) -> DataFrame:
    """Products of edge weights (``parent``, ``child``, ``weight``) from the start of each target's path (with ``step``) to each edge."""
    along = Window.partitionBy("target").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return paths.join(weight, ["parent", "child"]).select("target", "step", "parent", "child", F.product("weight").over(along).alias("weight"))


def whole_accuracy(x: DataFrame, targets: DataFrame, attributes: DataFrame, paths: DataFrame, truth: DataFrame, folds: int = 5, kind="logistic", options: dict | None = None, mode: str = "directional") -> DataFrame:
    """Accuracy of the whole hierarchy on each fold (observations by a hash), models fitted on the others: ``fold``, ``accuracy``."""
    if mode == "component":
        raise ValueError("component predictions have no single class")
    spark, out = x.sparkSession, []
    part = F.pmod(F.xxhash64("obs"), F.lit(folds))
    for f in range(folds):
        test = x.where(part == f)
        if test.isEmpty():
            continue
        edges = kept(fit_submodels(x.where(part != f), targets.where(part != f), attributes, kind, options, test))
        hit = predict(edges, paths, mode).join(truth, "obs").agg(F.avg(F.when(F.col("target") == F.col("class"), 1.0).otherwise(0.0))).head()[0]
        out.append((f, hit))
    return spark.createDataFrame(out, "fold int, accuracy double")


def most_likely(probabilities: DataFrame) -> DataFrame:
    return probabilities.groupBy("obs").agg(F.max_by("target", F.struct("p", "target")).alias("target"))


def validate_submodels(x: DataFrame, targets: DataFrame, attributes: DataFrame, folds: int = 5, kind="logistic", options: dict | None = None, seed: int = 0) -> DataFrame:
    """Mean accuracy and standard error over stratified folds of every submodel alone: ``submodel``, ``accuracy``, ``sem``."""
    out = []
    for r in targets.select("submodel").distinct().orderBy("submodel").collect():  # a row a submodel
        cells = x.join(attributes.where(F.col("submodel") == r.submodel).select("attr"), "attr", "left_semi")
        y = targets.where(F.col("submodel") == r.submodel).select("obs", F.col("child").alias("class"))
        m, classes, _ = to_wide(cells, y)
        fold, rng = np.empty(len(classes), int), np.random.RandomState(seed)
        for c in np.unique(classes):
            rows = rng.permutation(np.flatnonzero(classes == c))
            fold[rows] = np.arange(len(rows)) % folds
        acc = [float((make(kind, options or {}).fit(m[fold != f], classes[fold != f]).predict(m[fold == f]) == classes[fold == f]).mean()) for f in np.unique(fold)]
        out.append((r.submodel, float(np.mean(acc)), float(np.std(acc, ddof=1) / np.sqrt(len(acc))) if len(acc) > 1 else None))
    return x.sparkSession.createDataFrame(out, f"submodel {dict(targets.dtypes)['submodel']}, accuracy double, sem double")


def descend(edges: DataFrame, root) -> DataFrame:
    """Follows the likeliest child from the root to a node without children; a circle is an error."""
    step = edges.groupBy("obs", "parent").agg(F.max_by("child", F.struct("p", "child")).alias("child"))
    at = edges.select("obs").distinct().withColumn("node", F.lit(root))
    n = step.select("parent").distinct().count()
    for _ in range(n + 1):
        moved = at.join(step.withColumnRenamed("parent", "node"), ["obs", "node"], "left")
        if moved.where("child is not null").isEmpty():
            return at
        at = kept(moved.select("obs", F.coalesce("child", "node").alias("node")))
    raise ValueError("the likeliest children form a circle")


def target_scores(accuracy: DataFrame, paths: DataFrame) -> DataFrame:
    """Product of the submodels' accuracies on each target's path."""
    return paths.select("target", F.col("parent").alias("submodel")).distinct().join(accuracy, "submodel").groupBy("target").agg(F.product("accuracy").alias("score"))
