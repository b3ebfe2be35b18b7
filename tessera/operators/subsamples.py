"""Pearson correlations of all pairs of attributes in seeded subsamples of the observations, as matrix products.

In long form every subsample joins its cells with themselves.  Here the
observations are packed once into chunks (a hash of each, and its cells); for a
group of subsamples a task streams its chunks and adds up, a subsample, the
product of the chosen rows with themselves.  Which observations a subsample has
follows from their hashes and one threshold a subsample, found exactly.  What
is sent between tasks is a square of the attributes for each subsample and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_folder

#: Most observations of a chunk, its cells if all are there, rows multiplied at a time, bytes of sums that a task holds, and most subsamples of a group.
MOST, CHUNK, ROWS, HELD, GROUP = 1 << 16, 4_000_000, 4096, 32 << 20, 50
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _hash(value: int, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of an integer literal after columns whose hashes are ``seed``."""
    with np.errstate(over="ignore"):
        if -(2**31) <= value < 2**31:
            h = _turn((seed + _P5 + np.uint64(4)) ^ np.uint64((value & 0xFFFFFFFF) * int(_P1) % 2**64), 23) * _P2 + _P3
        else:
            v = (value % 2**64) * int(_P2) % 2**64
            h = _turn((seed + _P5 + np.uint64(8)) ^ np.uint64((v << 31 | v >> 33) % 2**64 * int(_P1) % 2**64), 27) * _P1 + _P4
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        return h ^ h >> np.uint64(32)


def draw(hashes: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """What ranks observations in a subsample: the order of ``xxhash64(obs, turn, seed)``, as unsigned numbers."""
    return _hash(seed, _hash(turn, hashes)) ^ np.uint64(1 << 63)


def _packed(cells: DataFrame, names: DataFrame, n: int, m: int) -> DataFrame:
    """Chunks of observations: their hashes, how many cells each has, and the cells by number of the attribute."""
    chunks = max(1, -(-n * m // CHUNK), -(-n // MOST))
    h = F.xxhash64("obs")
    rows = cells.join(F.broadcast(names), "attr").select(F.pmod(F.xxhash64("obs", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"), h.alias("h"), F.xxhash64(F.lit(2), "obs").alias("g"), "at", F.col("v").cast("double").alias("v"))

    def pack(chunk: pa.Table) -> pa.Table:
        h, g, at, v = (chunk.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("h", "g", "at", "v"))
        by = np.lexsort((at, g, h))
        h, g, at, v = h[by], g[by], at[by], v[by]
        new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
        if (~new[1:] & (at[1:] == at[:-1])).any():
            raise ValueError("an observation has two cells of one attribute")
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(h))).astype(np.int32)
        return pa.table({"hashes": pa.array([h[first].tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()), "attrs": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "cells": pa.array([v.tobytes()], pa.binary())})

    path = new_folder(cells.sparkSession)
    rows.groupBy("chunk").applyInArrow(pack, "hashes binary, sizes binary, attrs binary, cells binary").write.option("compression", "zstd").parquet(path)
    return cells.sparkSession.read.parquet(path)


def _thresholds(packed: DataFrame, n: int, size: int, n_iter: int, seed: int) -> np.ndarray:
    """The ``size``-th least draw of every subsample.  Draws in a window around the expected one are sorted; a wider one follows where that misses."""
    found, todo, width = np.zeros(n_iter, np.uint64), list(range(n_iter)), 6.0
    while todo:
        gap = width * (size / n * (1 - size / n) / n) ** 0.5 + 2 / n
        low, high = (np.uint64(min(max(int((size / n + s * gap) * 2**64), 0), 2**64 - 1)) for s in (-1, 1))
        turns = list(todo)

        def near(batches):
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    h = np.frombuffer(raw, np.uint64)
                    below, some = [], []
                    for t in turns:
                        u = draw(h, t, seed)
                        below.append(int((u < low).sum()))
                        some.append(u[(u >= low) & (u <= high)].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(turns, pa.int32()), pa.array(below, pa.int64()), pa.array(some, pa.binary())], names=["iter", "below", "some"])

        def settle(group: pa.Table) -> pa.Table:
            u = np.sort(np.frombuffer(b"".join(group.column("some").to_pylist()), np.uint64))
            k = size - 1 - sum(group.column("below").to_pylist())
            inside = 0 <= k < len(u) - (size < n)
            if inside and k + 1 < len(u) and u[k] == u[k + 1]:
                raise ValueError("two observations have one draw at the edge of a subsample; take another seed")
            return pa.table({"iter": group.column("iter")[:1], "u": pa.array([int(u[k].view(np.int64)) if inside else None], pa.int64())})

        rows = packed.select("hashes").mapInArrow(near, "iter int, below long, some binary").groupBy("iter").applyInArrow(settle, "iter int, u long").collect()
        for r in rows:
            if r.u is not None:
                found[r.iter] = np.array([r.u], np.int64).view(np.uint64)[0]
        todo = [r.iter for r in rows if r.u is None]
        width *= 16
    return found


def correlations(cells: DataFrame, n_iter: int, size: int, n: int, seed: int = 0, fill: float | None = None) -> DataFrame:
    """``iter``, ``node_a``, ``node_b``, ``v``: the correlation of two attributes over the observations of each subsample that have both.

    A subsample is the ``size`` observations (of ``n``) whose ``xxhash64(obs,
    iter, seed)`` is least.  Absent and NULL cells are ``fill`` if that is given.
    Pairs that never meet in a subsample have no row, constant ones NULL.
    """
    spark, kind = cells.sparkSession, dict(cells.dtypes)["attr"]
    cells = cells.where("obs is not null and attr is not null")
    if fill is None:
        cells = cells.where("v is not null")
    v = F.coalesce(F.col("v").cast("double"), F.lit(fill)) if fill is not None else F.col("v").cast("double")
    cells = cells.withColumn("v", v)
    axis = cells.groupBy("attr").agg(F.count(F.lit(1)).alias("c"), F.sum("v").alias("s"), F.bool_and(F.col("v") == F.rint("v")).alias("whole")).orderBy("attr").collect()  # a row an attribute
    m, given = len(axis), sum(r.c for r in axis)
    full = fill is not None or given == n * m
    whole = np.array([bool(r.whole) for r in axis]) & (fill is None or float(fill).is_integer())
    mean = np.array([(r.s + (fill * (n - r.c) if fill is not None else 0)) / (n if full else r.c) for r in axis], float)
    shift = np.where(whole, np.rint(mean), mean)  # whole numbers stay whole, so their sums are exact
    names = spark.createDataFrame([(i, r.attr) for i, r in enumerate(axis)], f"at int, attr {kind}")
    if m < 2 or n_iter < 1:
        return spark.createDataFrame([], f"iter int, node_a {kind}, node_b {kind}, v double")
    packed = _packed(cells, names, n, m)
    edge = spark.sparkContext.broadcast(_thresholds(packed, n, size, n_iter, seed))
    wide = m + 1 if full else 3 * m
    group = max(1, min(GROUP, HELD // (8 * wide * wide)))
    tri = np.triu_indices(wide)

    def multiply(batches):
        sums, turns = None, None
        for batch in batches:
            for part, *raw in zip(*(batch.column(c).to_pylist() for c in ("part", "hashes", "sizes", "attrs", "cells")), strict=True):
                if sums is None:
                    turns = range(part * group, min(n_iter, (part + 1) * group))
                    sums = np.zeros((len(turns), wide, wide))
                h, sizes, at, v = (np.frombuffer(x, t) for x, t in zip(raw, (np.uint64, np.int32, np.int32, np.float64), strict=True))
                ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
                for lo in range(0, len(h), ROWS):
                    hi = min(lo + ROWS, len(h))
                    i, j = ends[lo], ends[hi]
                    row = np.repeat(np.arange(hi - lo), sizes[lo:hi])
                    a = np.zeros((hi - lo, wide))
                    if full:
                        a[:, :m] = (fill or 0.0) - shift
                        a[:, m] = 1
                    a[row, at[i:j]] = v[i:j] - shift[at[i:j]]
                    if not full:
                        a[row, m + at[i:j]] = 1
                        a[:, 2 * m :] = a[:, :m] ** 2
                    for k, t in enumerate(turns):
                        some = a[np.flatnonzero(draw(h[lo:hi], t, seed) <= edge.value[t])]
                        sums[k] += some.T @ some
        if sums is not None:
            for k, t in enumerate(turns):
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([sums[k][tri].tobytes()], pa.binary())], names=["iter", "sums"])

    def settle(rows: pa.Table) -> pa.Table:
        s = np.zeros((wide, wide))
        s[tri] = np.sum([np.frombuffer(x) for x in sorted(rows.column("sums").to_pylist())], axis=0)
        s = s + np.triu(s, 1).T
        if full:
            count = np.full((m, m), s[m, m])
            sx = np.repeat(s[:m, m:], m, axis=1)  # of the first of a pair, over the rows of both
            sxx = np.repeat(np.diag(s)[:m, None], m, axis=1)
        else:
            count, sx, sxx = s[m : 2 * m, m : 2 * m], s[:m, m : 2 * m], s[2 * m :, m : 2 * m]
        var = count * sxx - sx * sx
        var[(var <= np.where(whole, 0, 1e-13)[:, None] * count * sxx)] = 0
        x, y = np.triu_indices(m, 1)
        meet = count[x, y] > 0
        x, y = x[meet], y[meet]
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (count[x, y] * s[x, y] - sx[x, y] * sx[y, x]) / (np.sqrt(var[x, y]) * np.sqrt(var[y, x]))
        none = (var[x, y] == 0) | (var[y, x] == 0)
        return pa.table({"iter": pa.array(np.full(len(x), rows.column("iter")[0].as_py(), np.int32)), "a": pa.array(x.astype(np.int32)), "b": pa.array(y.astype(np.int32)), "v": pa.array(r, mask=none)})

    parts = [packed.withColumn("part", F.lit(k)) for k in range(-(-n_iter // group))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    draws = every.mapInArrow(multiply, "iter int, sums binary").groupBy("iter").applyInArrow(settle, "iter int, a int, b int, v double")
    path = new_folder(spark)
    draws.write.option("compression", "zstd").parquet(path)
    a, b = (names.select(F.col("at").alias(s), F.col("attr").alias(f"node_{s}")) for s in "ab")
    return spark.read.parquet(path).join(F.broadcast(a), "a").join(F.broadcast(b), "b").select("iter", "node_a", "node_b", "v")
