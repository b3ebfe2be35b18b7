"""Structured Streaming over events: depth and richness by window, and network snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depth_richness(events: DataFrame, window: str = "1 hour", late: str = "2 hours", ts: str = "ts", obs: str = "user_id", attr: str = "event_type", v: str = "value") -> DataFrame:
    """Sum, count and approximate number of attributes of each observation and tumbling window; works on streams and tables."""
    w = F.window(ts, window)
    rows = events.withWatermark(ts, late).groupBy(w.alias("w"), obs).agg(F.sum(v).alias("depth"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct(attr).alias("richness"))
    return rows.select(F.col("w.start").alias("start"), obs, "depth", "n", "richness")


def contacts(events: DataFrame, window: str = "1 day", late: str = "2 days", ts: str = "ts", node: str = "event_type", by: str = "user_id") -> DataFrame:
    """The set of nodes that each ``by`` touches in a window, from which edges of a snapshot unfold."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.array_sort(F.collect_set(node)).alias("nodes"))
    pairs = F.flatten(F.transform("nodes", lambda a: F.transform(F.filter("nodes", lambda b: a < b), lambda b: F.struct(a.alias("node_a"), b.alias("node_b")))))
    return rows.select(F.col("w.start").alias("t"), by, F.explode(pairs).alias("e")).select("t", by, "e.node_a", "e.node_b")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts", key: str = "user_id") -> DataFrame:
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
