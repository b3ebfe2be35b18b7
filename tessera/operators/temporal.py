"""Temporal networks: edges (``t``, ``node_a``, ``node_b``, ``weight``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept

EDGE = ("node_a", "node_b")


def intratemporal(edges: DataFrame, mode: str = "value") -> DataFrame:
    v = {"value": F.col("weight"), "abs": F.abs("weight"), "sign": F.signum("weight")}[mode]
    return edges.withColumn("weight", v)


def node_times(edges: DataFrame) -> DataFrame:
    """The time points of every node."""
    return edges.select("t", F.explode(F.array("node_a", "node_b")).alias("node")).groupBy("node").agg(F.array_sort(F.collect_set("t")).alias("times"))


def intertemporal(edges: DataFrame) -> DataFrame:
    """Links of a node to itself at its next time."""
    seen = edges.select("t", F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
    return seen.withColumn("t_next", F.lead("t").over(Window.partitionBy("node").orderBy("t"))).where("t_next is not null")


def intercontact_times(edges: DataFrame) -> DataFrame:
    """Gaps between successive contacts of an edge."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*EDGE).orderBy("t"))
    return edges.withColumn("gap", gap).where("gap is not null").select(*EDGE, "t", "gap")


def burstiness(edges: DataFrame) -> DataFrame:
    """(sd - mean) / (sd + mean) of each edge's gaps."""
    g = intercontact_times(edges).groupBy(*EDGE).agg(F.stddev_pop("gap").alias("s"), F.avg("gap").alias("m"))
    return g.select(*EDGE, F.try_divide(F.col("s") - F.col("m"), F.col("s") + F.col("m")).alias("burstiness"))


def local_variation(edges: DataFrame) -> DataFrame:
    """3 / (n - 1) times the sum of squared relative changes of successive gaps."""
    g = intercontact_times(edges).withColumn("after", F.lead("gap").over(Window.partitionBy(*EDGE).orderBy("t"))).where("after is not null")
    change = F.pow((F.col("gap") - F.col("after")) / (F.col("gap") + F.col("after")), 2)
    return g.groupBy(*EDGE).agg((3 * F.avg(change)).alias("local_variation"))


def temporal_degree(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """Sum (or number) of a node's edges at each time."""
    v = F.sum("weight") if weighted else F.count(F.lit(1))
    return edges.select("t", F.explode(F.array("node_a", "node_b")).alias("node"), "weight").groupBy("node", "t").agg(v.alias("degree"))


def volatility(edges: DataFrame) -> DataFrame:
    """Edges that appear or vanish between successive times, per step."""
    times = edges.select("t").distinct().withColumn("next", F.lead("t").over(Window.orderBy("t")))
    now = edges.select("t", *EDGE).distinct()
    was = now.join(times.where("next is not null"), "t").select(F.col("next").alias("t"), *EDGE, F.lit(1).alias("before"))
    both = now.withColumn("after", F.lit(1)).join(was, ["t", *EDGE], "full")
    first = times.agg(F.min("t").alias("t0"))
    return both.crossJoin(F.broadcast(first)).where("t > t0").groupBy("t").agg(F.count_if(F.col("before").isNull() | F.col("after").isNull()).alias("changes"))


def fluctuability(edges: DataFrame) -> DataFrame:
    """Distinct edges over all contacts."""
    return edges.agg((F.count_distinct(*EDGE) / F.count(F.lit(1))).alias("fluctuability"))


def participation(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """1 - sum over modules of the squared share of a node's degree, per time."""
    both = edges.select("t", "node_a", "node_b", "weight").unionByName(edges.select("t", F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b"), "weight"))
    k = both.join(modules.select(F.col("node").alias("node_b"), "module"), "node_b").groupBy("t", F.col("node_a").alias("node"), "module").agg(F.sum("weight").alias("k"))
    return k.groupBy("t", "node").agg((1 - F.try_divide(F.sum(F.col("k") * F.col("k")), F.pow(F.sum("k"), 2))).alias("participation"))


def earliest_arrival(edges: DataFrame, source, start=None) -> DataFrame:
    """First time at which each node can be reached from a source over edges of strictly later times."""
    both = edges.select("t", F.col("node_a").alias("x"), F.col("node_b").alias("y")).unionByName(edges.select("t", F.col("node_b").alias("x"), F.col("node_a").alias("y")))
    spark = edges.sparkSession
    reached = spark.createDataFrame([(source, float("-inf") if start is None else float(start))], f"node {dict(edges.dtypes)['node_a']}, t0 double")
    while True:
        more = both.join(reached, F.col("x") == F.col("node")).where("t > t0").groupBy("y").agg(F.min(F.col("t").cast("double")).alias("t0")).select(F.col("y").alias("node"), "t0")
        new = kept(reached.unionByName(more).groupBy("node").agg(F.min("t0").alias("t0")))
        if new.exceptAll(reached).isEmpty():
            return new
        reached = new
