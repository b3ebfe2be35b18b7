"""SimHash near-duplicates with a sharded forest of vantage-point trees.

Fingerprints have 64 bits.  To find all pairs within ``radius`` bits, the bits
are cut into ``n_blocks`` equal blocks; two such fingerprints differ by at most
``radius // n_blocks`` bits (the tree's reach) in one of them.  Each block has a
vantage-point tree in the Hamming distance of that block: an inner node holds a
vantage point and a threshold, a leaf is a shard.  A fingerprint is at home in one
shard of each tree and is a guest in every other shard that the triangle
inequality leaves within reach: those whose boundary overlaps its ball.  Where
fingerprints agree in the whole block, nodes split them by all 64 bits, with
``radius`` as reach, so that such a group has several shards too.  The trees are
fitted on a bounded sample; all fingerprints are sharded.  In a shard, distances
of all 64 bits to a vantage point order the fingerprints into rings, rings further
apart than the radius are pruned by the triangle inequality, and what is at home
is compared exactly with the rest.

Equal fingerprints are one node.  A shard gives a star a component, never its
pairs; components are then joined over the cluster.

Edge cases: null, empty and blank texts have fingerprint zero, linked like any
other.  A null ``doc_id`` gets a component like any row but names none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import LOWER, blocks, utf8, words
from ._links import components, kept

RADIUS, BLOCKS = 3, 2
#: Fingerprints that trees are fitted on, at most, and those a shard should hold.
SAMPLE, SHARD = 100_000, 2000

_SPREAD = np.zeros(256, np.uint64)  # the bits of a byte as eight counters
for _k in range(8):
    _SPREAD |= (np.arange(256, dtype=np.uint64) >> np.uint64(_k) & np.uint64(1)) << np.uint64(8 * _k)


def fingerprint_block(data: np.ndarray, off: np.ndarray, size: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints of the rows of a block of texts."""
    n = len(off) - 1
    data = LOWER[data]
    starts, ends, doc = words(data, off)
    count = np.bincount(doc, minlength=n)
    # the words of a row, joined by one space
    long = ends - starts
    if len(starts):
        total = np.cumsum(long + 1)
        begin = total - long - 1
        line = np.full(total[-1], 32, np.uint8)
        span = np.cumsum(long)
        line[np.repeat(begin - (span - long), long) + np.arange(span[-1])] = data[np.repeat(starts - (span - long), long) + np.arange(span[-1])]
    else:
        begin, line = np.zeros(0, np.int64), np.zeros(0, np.uint8)
    first = np.cumsum(count) - count  # first word of each row
    shingles = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    heads = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    owner = np.repeat(np.arange(n), shingles)
    tails = np.minimum(heads + size - 1, (first + count - 1)[owner])
    stop = begin[tails] + long[tails]
    raw, digest = line.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[i:j], seed) for i, j in zip(begin[heads].tolist(), stop.tolist(), strict=True)), np.uint64, len(heads))
    # bit counts, in runs of at most 255 shingles of one row
    within = np.arange(len(h)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    runs = np.flatnonzero(within % 255 == 0)
    out = np.zeros(n, np.uint64)
    if len(runs):
        rows = owner[runs]
        edge = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        octets = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            sums = np.add.reduceat(_SPREAD[octets[:, k]], runs).view(np.uint8).reshape(-1, 8).astype(np.int64)
            sums = np.add.reduceat(sums, edge, axis=0)
            bits = 2 * sums > shingles[rows[edge]][:, None]
            out[rows[edge]] |= (bits.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), size: int = 3) -> DataFrame:
    """Keys and the fingerprint (``fp``, as a signed long) of every row."""
    from pyspark.sql.types import LongType, StructField, StructType

    chosen = docs.select(F.col(text).alias("__text"), *keys)
    schema = StructType([*chosen.schema.fields[1:], StructField("fp", LongType())])

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in blocks(off):
                fp = fingerprint_block(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[1:], pa.array(fp.view(np.int64))], names=schema.names)

    return chosen.mapInArrow(run, schema)


_ALL = np.uint64(2**64 - 1)


def fit_tree(values: np.ndarray, mask: np.uint64, reach: int, radius: int, leaves: int, rng: np.random.Generator) -> list[tuple]:
    """A vantage-point tree: nodes (mask, point, threshold, reach, inner, outer); a negative child -1-k is shard k.

    A fingerprint lies inside if its distance to the point, in the bits of the
    mask, is at most the threshold.  What the mask cannot split is split by all bits.
    """
    nodes: list[tuple] = []
    shard = 0

    def grow(part: np.ndarray, want: int) -> int:
        nonlocal shard
        for bits, far in ((mask, reach), (_ALL, radius)) if want > 1 and len(part) > 1 else ():
            for point in rng.choice(part, min(4, len(part)), replace=False):
                d = np.bitwise_count((part ^ point) & bits).astype(np.int64)
                mu = int(np.sort(d)[(len(d) - 1) // 2])
                mu = mu if (d > mu).any() else mu - 1
                inside = d <= mu
                if inside.any() and not inside.all():
                    me = len(nodes)
                    nodes.append(())
                    share = min(want - 1, max(1, round(want * inside.mean())))
                    inner = grow(part[inside], share)
                    nodes[me] = (int(bits), int(point), mu, far, inner, grow(part[~inside], want - share))
                    return me
        shard += 1
        return -shard

    root = grow(values, leaves)
    return nodes if root >= 0 else []


def route(values: np.ndarray, nodes: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (place in values, shard, whether at home there) that the triangle inequality leaves within reach of a value."""
    if not nodes:
        return np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
    found, todo = [], [(0, np.arange(len(values)), np.ones(len(values), bool))]
    while todo:
        k, who, home = todo.pop()
        if k < 0:
            found.append((who, np.full(len(who), -1 - k), home))
            continue
        mask, point, mu, reach, inner, outer = nodes[k]
        d = np.bitwise_count((values[who] ^ np.uint64(point)) & np.uint64(mask)).astype(np.int64)
        for child, near, own in ((inner, d - reach <= mu, d <= mu), (outer, d + reach > mu, d > mu)):
            if near.any():
                todo.append((child, who[near], (home & own)[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _top(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def stars(own: np.ndarray, guests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links to the least of its component for every fingerprint, over all pairs of which one is at home; found by rings around a vantage point."""
    fp = np.concatenate((own, guests))
    n = len(fp)
    if not len(own):
        return fp[:0], fp[:0]
    d = np.bitwise_count(fp ^ own[0]).astype(np.int64)
    by = np.argsort(d, kind="stable")
    fp, d, home = fp[by], d[by], np.flatnonzero(by < len(own))
    parent = np.arange(n)
    step = 64
    for i in range(0, len(home), step):
        rows = home[i : i + step]
        # beyond these rings, the triangle inequality rules out a link
        lo, hi = np.searchsorted(d, d[rows[0]] - radius), np.searchsorted(d, d[rows[-1]] + radius, "right")
        near = np.bitwise_count(fp[rows, None] ^ fp[None, lo:hi]) <= radius
        for k in np.flatnonzero(near.sum(axis=1) > 1):
            top = _top(parent, lo + np.flatnonzero(near[k]))
            parent[top] = top.min()
    label = _top(parent, np.arange(n))
    order = np.lexsort((fp, label))
    first = np.append(True, label[order][1:] != label[order][:-1])
    least = np.empty(n, np.uint64)
    least[order] = fp[order][first][np.cumsum(first) - 1]
    linked = least != fp
    return fp[linked], least[linked]


def links(nodes: DataFrame, radius: int = RADIUS, n_blocks: int = BLOCKS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of all pairs of fingerprints (column ``fp``, distinct) within the radius."""
    n = nodes.count()
    width, reach = 64 // n_blocks, radius // n_blocks
    if 64 % n_blocks:
        raise ValueError("blocks must divide 64")
    seen = nodes.select("fp").sample(fraction=min(1.0, sample / max(1, n)), seed=7).limit(sample) if n > sample else nodes.select("fp")
    values = np.sort(np.array([r.fp for r in seen.collect()], np.int64)).view(np.uint64)
    low = (1 << width) - 1
    rng = np.random.default_rng(11)
    trees = [fit_tree(values, np.uint64(low << width * t), reach, radius, max(1, -(-n // shard)), rng) for t in range(n_blocks)]

    def deal(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0), np.int64).view(np.uint64)
            for t, tree in enumerate(trees):
                place, leaf, home = route(fp, tree)
                by = np.lexsort((~home, leaf))
                place, leaf, home = place[by], leaf[by], home[by]
                found, at = np.unique(leaf, return_index=True)
                cut = list(zip(at, at + np.add.reduceat(home, at), [*at[1:], len(by)], strict=True)) if len(by) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), t, np.int32)), pa.array(found.astype(np.int32)), *(pa.array([fp[place[i:j]].tobytes() for i, j in side], pa.binary()) for side in ([c[:2] for c in cut], [c[1:] for c in cut]))],
                    names=["tree", "leaf", "fps", "guests"],
                )

    def join(part: pa.Table) -> pa.Table:
        a, b = stars(*(np.unique(np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64)) for c in ("fps", "guests")), radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return nodes.select("fp").mapInArrow(deal, "tree int, leaf int, fps binary, guests binary").groupBy("tree", "leaf").applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (the smallest key reachable over links) of every row."""
    rows = kept(fingerprints(docs, text, (key,), size))
    nodes = kept(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(nodes, radius))
    named = roots.join(nodes.withColumnRenamed("fp", "node"), "node")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(ids, "root").select(F.col("node").alias("fp"), "component_id")
    every = kept(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))  # so that a hot fingerprint's rows can be split in the join
    return rows.join(every, "fp").select(key, "fp", "component_id")


def first_of_each(docs: DataFrame, nodes: DataFrame, roots: DataFrame, text: str, key: str) -> DataFrame:
    """One row of each component of ``nodes`` (``node`` and its ``least`` row): that of the smallest key, then of the smallest hash of its text.

    A null key comes last.  Of rows equal in key and text, one stays, chosen by
    the hash of all its columns (of which none may be a map).
    """
    stay = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("r")).select(F.col("r.k").alias("__k"), F.col("r.h").alias("__h"))
    mine = [F.col(key).alias("__k"), F.xxhash64(text).alias("__h")]
    once = docs.groupBy(*mine).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row"))  # repeated rows become one before they are sent
    return once.alias("o").join(stay.alias("s"), F.expr("o.__k <=> s.__k and o.__h = s.__h"), "left_semi").select("__row.*")


def least_row(text: str, key: str):
    """The rank of a row among those of its component: null keys last, then by key and text."""
    return F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.xxhash64(text).alias("h"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """One row of each component of fingerprints: see ``first_of_each``."""
    rows = fingerprints(docs.withColumn("__least", least_row(text, key)), text, ("__least",), size)
    nodes = kept(rows.groupBy("fp").agg(F.min("__least").alias("least")))
    return first_of_each(docs, nodes.withColumnRenamed("fp", "node"), components(links(nodes, radius)), text, key)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
