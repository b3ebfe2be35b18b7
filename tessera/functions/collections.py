"""Helpers on map and array columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_reverse(m: Column) -> Column:
    """Values to keys; of keys with one value the last stays."""
    return F.aggregate(F.map_entries(m), F.map_from_entries(F.transform(F.slice(F.map_entries(m), 1, 0), lambda e: F.struct(e["value"], e["key"]))), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["value"]), F.create_map(e["value"], e["key"])))


def map_keep(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, _: F.array_contains(keys, k))


def map_fill(m: Column, keys: Column, value) -> Column:
    """Adds missing keys with a value."""
    missing = F.array_except(keys, F.map_keys(m))
    return F.map_concat(m, F.map_from_arrays(missing, F.transform(missing, lambda _: F.lit(value))))


def map_expand(df: DataFrame, m: str, key: str = "key", value: str = "value") -> DataFrame:
    """A row an entry; array values unfold further."""
    rows = df.select(*[c for c in df.columns if c != m], F.explode(m).alias(key, value))
    return rows.withColumn(value, F.explode(value)) if dict(rows.dtypes)[value].startswith("array") else rows


def intersection(*sets: Column) -> Column:
    return reduce(F.array_intersect, sets)


def union(*sets: Column) -> Column:
    return reduce(F.array_union, sets)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def both_known(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where neither of two columns is missing or NaN."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(ok(a) & ok(b))


def pad_left(c: Column, size: int, fill: str = "0") -> Column:
    """Text of at least ``size`` characters; longer text stays whole."""
    text = c.cast("string")
    return F.when(F.length(text) >= size, text).otherwise(F.lpad(text, size, fill))


def boolean(c: Column) -> Column:
    """True for yes, y, true, t, on and 1, false for their opposites, NULL for all else, whatever the case."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("yes", "y", "true", "t", "on", "1"), True).when(text.isin("no", "n", "false", "f", "off", "0"), False)


def to_precision(c: Column, digits: int = 5) -> Column:
    """Text with that many decimals."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def consecutive_replace(c: Column, changes: list[tuple[str, str]]) -> Column:
    """Replaces each text by its other, one pair after another."""
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), changes, c)


def join_as_strings(sep: str, *parts: Column) -> Column:
    """Parts as text around a separator; missing ones drop out."""
    return F.concat_ws(sep, *[p.cast("string") for p in parts])


def range_like(a: Column) -> Column:
    """0 .. n-1 for an array of n."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).when(F.size(a) == 0, F.array().cast("array<int>"))


def collapse(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values to the sorted keys that have them."""
    return df.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias(key))


def nested(df: DataFrame, path: list[str], value: str) -> DataFrame:
    """Rows of columns as keys of one path a row: ``path`` (an array) and ``value``."""
    return df.select(F.array(*[F.col(c).cast("string") for c in path]).alias("path"), F.col(value).alias("value"))


def asymmetry(edges: DataFrame, a: str = "node_a", b: str = "node_b", weight: str = "weight") -> DataFrame:
    """The greatest difference between both directions of an edge list that has both, and the directions without the other."""
    turned = edges.select(F.col(b).alias(a), F.col(a).alias(b), F.col(weight).alias("__back"))
    return edges.join(turned, [a, b], "left").agg(F.max(F.abs(F.col(weight) - F.col("__back"))).alias("difference"), F.count_if(F.col("__back").isNull()).alias("lone"))
