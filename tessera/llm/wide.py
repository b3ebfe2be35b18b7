"""Near-duplicates by similarity: wide SimHash fingerprints in a forest of vantage-point trees.

Documents are alike if the Jaccard similarity of their sets of ``SIZE``-word
shingles (letters A-Z in lower case) is at least ``ALIKE``.  Such sets differ in
about 15 of 100 SimHash bits, too many for a radius in 64 bits to tell from chance.
A fingerprint here has as many bits as it takes for a pair at the threshold to
agree wholly in one of its blocks with probability ``RECALL`` or more; a block has
at least ``WIDTH`` bits, and more as the documents grow in number.  Each block has
a vantage-point tree (reach 0, so no shard has guests) that deals documents to
shards.  In a shard, documents of one block value are compared by a further word
of bits and by the sizes of their sets; the candidates' least spanning forest goes
on, never all pairs.  Links whose estimate from all bits is within four standard
errors of the threshold, and all of short texts, are then settled by their sets.

Texts of the same words are one node, told by 64 bits (of 5e10 texts, 70 such
pairs are expected to share them).  Sets are compared by 32 bits a shingle.
A block value's documents are one task's work.

Edge cases: texts of fewer words than a shingle have their whole sequence as one;
null, empty and blank texts are alike.  Null keys, repeated rows and ties: see
``simhash.first_of_each``.  Empty tables give empty tables; extra columns are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import LOWER, blocks, mix, pack_sorted, prefix, release, span_hash, unpack_sorted, utf8, windows, words
from ._links import components, kept, stored
from .simhash import _ALL, _SPREAD, first_of_each, fit_tree, least_row, route

SIZE, ALIKE, RECALL, WIDTH = 5, 0.8, 0.98, 16
#: Fingerprints that trees are fitted on, at most, and those a shard should hold.
SAMPLE, SHARD = 20_000, 2000
#: Sets below this size are always compared themselves.
SHORT = 64
#: Standard errors that an estimate may be off.
ERRORS = 4

_ROW = np.dtype([("v", "<u4"), ("n", "<u4"), ("id", "<u8"), ("bits", "<u8")])


def bit_share(alike: float) -> float:
    """The share of bits in which sets of this similarity (and equal sizes) differ."""
    return math.acos(2 * alike / (1 + alike)) / math.pi


def layout(n: int, alike: float = ALIKE) -> tuple[int, int]:
    """Bits a block and blocks a fingerprint for ``n`` documents."""
    width = min(32, max(WIDTH, math.ceil(math.log2(max(2, n))) - 6))
    return width, math.ceil(math.log(1 - RECALL) / math.log1p(-((1 - bit_share(alike)) ** width)))


def sketch_block(data: np.ndarray, off: np.ndarray, size: int, n_words: int):
    """Per row of a block of texts: its name, its set of shingles (rows and ascending hashes) and its bits."""
    n = len(off) - 1
    low = LOWER[data]
    name = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(low[i:j].tobytes().split())) for i, j in zip(off[:-1], off[1:], strict=True)), np.uint64, n)
    starts, ends, doc = words(low, off)
    h, at = windows(span_hash(prefix(low), starts, ends), doc, size)
    count = np.bincount(doc, minlength=n)
    few = np.flatnonzero((count > 0) & (count < size))
    rows, h = np.concatenate((doc[at], few)), np.concatenate((h, name[few]))
    by = np.lexsort((h, rows))
    rows, h = rows[by], h[by]
    one = np.ones(len(h), bool)
    one[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    rows, h = rows[one], h[one]
    sizes = np.bincount(rows, minlength=n)
    bits = np.zeros((n, n_words), np.uint64)
    if len(h):
        within = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[rows]
        runs = np.flatnonzero(within % 255 == 0)  # eight counters of a byte hold 255
        owner = rows[runs]
        edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        some = owner[edge]
        for w in range(n_words):
            octets = mix(h + np.uint64(0x9E3779B97F4A7C15 * (w + 1) & 2**64 - 1)).view(np.uint8).reshape(-1, 8)
            for k in range(8):
                sums = np.add.reduceat(_SPREAD[octets[:, k]], runs).view(np.uint8).reshape(-1, 8).astype(np.int64)
                full = 2 * np.add.reduceat(sums, edge, axis=0) > sizes[some][:, None]
                bits[some, w] |= (full.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * k)
    return name, sizes, h, bits


def sketches(docs: DataFrame, n_words: int, text: str, key: str, size: int) -> DataFrame:
    """``id``, ``least`` (the row's rank), ``n`` shingles, ``fp`` and the set (``shingles``) of every row."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    chosen = docs.select(F.col(text).alias("__text"), least_row(text, key).alias("least"))
    schema = StructType([*_parse_datatype_string("id long").fields, chosen.schema["least"], *_parse_datatype_string("n int, fp binary, shingles binary").fields])

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in blocks(off):
                name, sizes, h, bits = sketch_block(data[off[i] : off[j]], off[i : j + 1] - off[i], size, n_words)
                ends = np.cumsum(sizes)
                short = (h >> np.uint64(32)).astype(np.uint32)
                sets = [pack_sorted(short[a:b]) for a, b in zip(ends - sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), batch.column(1).slice(i, j - i), pa.array(sizes.astype(np.int32)), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(sets, pa.binary())], names=schema.names)
        release()

    return chosen.mapInArrow(run, schema)


def block_values(bits: np.ndarray, width: int, t: int) -> np.ndarray:
    """Block ``t`` of each row of fingerprints (uint64 words)."""
    first, last = width * t // 64, (width * (t + 1) - 1) // 64
    shift = np.uint64(width * t % 64)
    out = bits[:, first] >> shift
    if last > first:
        out = out | bits[:, last] << (np.uint64(64) - shift)
    return out & np.uint64((1 << width) - 1)


def forest(rows: np.ndarray, most: int, alike: float) -> tuple[np.ndarray, np.ndarray]:
    """The least spanning forest of the candidate pairs (of one block value, at most ``most`` bits apart, of fitting sizes) of a shard."""
    rows = np.unique(rows)  # by block value
    v, n, bits = rows["v"], rows["n"].astype(float), rows["bits"]
    begin = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(v)))
    group = np.repeat(size, size)
    a, b, off = [], [], []
    for lag in range(1, min(64, int(size.max(initial=1)))):
        i = np.flatnonzero((v[lag:] == v[:-lag]) & (group[lag:] <= 64))
        d = np.bitwise_count(bits[i] ^ bits[i + lag])
        hit = (d <= most) & (np.minimum(n[i], n[i + lag]) >= alike * np.maximum(n[i], n[i + lag]))
        a.append(i[hit])
        b.append(i[hit] + lag)
        off.append(d[hit])
    x, y = [], []
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        by = np.argsort(np.concatenate(off), kind="stable")
        parent: dict[int, int] = {}

        def top(k: int) -> int:
            while (up := parent.get(k, k)) != k:
                parent[k] = k = parent.get(up, up)
            return k

        for i, j in zip(a[by].tolist(), b[by].tolist(), strict=True):
            p, q = top(i), top(j)
            if p != q:
                parent[p] = q
                x.append(i)
                y.append(j)
    for i, g in zip(begin[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        near, m = np.full(g, 255, np.uint8), n[i : i + g]
        joined, link = np.zeros(g, bool), np.zeros(g, np.int64)
        k = 0
        for _ in range(g - 1):
            joined[k] = True
            d = np.bitwise_count(bits[i : i + g] ^ bits[i + k])
            d[(d > most) | (np.minimum(m, m[k]) < alike * np.maximum(m, m[k]))] = 254
            better = d < near
            near[better] = d[better]
            link[better] = k
            near[joined] = 255
            k = int(near.argmin())
            if near[k] <= most:
                x.append(i + k)
                y.append(i + int(link[k]))
    return rows["id"][np.array(x, np.int64)], rows["id"][np.array(y, np.int64)]


def estimates(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities that pairs have at least and at most, by ``ERRORS`` standard errors of their differing bits."""
    total = bits_a.shape[1] * 64
    share = np.bitwise_count(bits_a ^ bits_b).sum(axis=1) / total
    error = ERRORS * np.sqrt(share * (1 - share) / total)
    out = []
    for p in (share + error, share - error):
        common = np.cos(np.pi * np.clip(p, 0, 0.5)) * np.sqrt(n_a * n_b)
        out.append(common / np.maximum(n_a + n_b - common, 1e-9))
    return out[0], out[1]


def _numbers(column, kind) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), kind)


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, alike: float = ALIKE, sample: int = SAMPLE, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Nodes (``node`` and its ``least`` row) and the ``root`` of those that have links."""
    width, trees = layout(docs.count(), alike)
    n_words = -(-width * trees // 64) + 1  # the last word tells candidates in a shard
    table = stored(sketches(docs, n_words, text, key, size))
    nodes = kept(table.groupBy("id").agg(F.min("least").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    n = nodes.count()
    seen = nodes.select("fp").sample(fraction=min(1.0, sample / max(1, n)), seed=7).limit(sample) if n > sample else nodes.select("fp")
    known = np.frombuffer(b"".join(sorted(bytes(r.fp) for r in seen.collect())), np.uint64).reshape(-1, n_words)
    rng = np.random.default_rng(13)
    grown = [fit_tree(block_values(known, width, t), _ALL, 0, 0, max(1, -(-n // shard)), rng) for t in range(trees)]
    p = bit_share(alike)
    most = math.floor(64 * p + 4 * math.sqrt(64 * p * (1 - p)))

    def deal(batches):
        for batch in batches:
            bits = utf8(batch.column(2))[0].view(np.uint64).reshape(-1, n_words)
            for t, tree in enumerate(grown):
                values = block_values(bits, width, t)
                place, leaf, _ = route(values, tree)
                by = np.argsort(leaf, kind="stable")
                place, leaf = place[by], leaf[by]
                rows = np.empty(len(place), _ROW)
                rows["v"], rows["n"], rows["id"], rows["bits"] = values[place], _numbers(batch.column(1), np.int64)[place], _numbers(batch.column(0), np.int64).view(np.uint64)[place], bits[place, -1]
                found, at = np.unique(leaf, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), t, np.int32)), pa.array(found.astype(np.int32)), pa.array([rows[i:j].tobytes() for i, j in zip(at, [*at[1:], len(rows)], strict=True)], pa.binary())], names=["tree", "leaf", "rows"])

    def join(part: pa.Table) -> pa.Table:
        a, b = forest(np.frombuffer(b"".join(part.column("rows").to_pylist()), _ROW), most, alike)
        return pa.table({"a": pa.array(np.minimum(a, b).view(np.int64)), "b": pa.array(np.maximum(a, b).view(np.int64))})

    def judge(batches):
        for batch in batches:
            sides = [utf8(batch.column(k))[0].view(np.uint64).reshape(-1, n_words) for k in (2, 3)]
            sizes = [_numbers(batch.column(k), float) for k in (4, 5)]
            low, high = estimates(*sides, *sizes)
            short = np.minimum(*sizes) < SHORT
            state = np.where(~short & (low >= alike), 1, np.where(~short & (high < alike), -1, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(state.astype(np.int32))], names=["a", "b", "state"])

    def compare(batches):
        for batch in batches:
            yes = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = unpack_sorted(x, np.uint32), unpack_sorted(y, np.uint32)
                both = np.isin(x, y, kind="sort").sum()
                yes[k] = both >= alike * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(yes)) for c in batch.columns[:2]], names=["a", "b"])

    pairs = kept(nodes.select("id", "n", "fp").mapInArrow(deal, "tree int, leaf int, rows binary").groupBy("tree", "leaf").applyInArrow(join, "a long, b long").distinct())
    side = {c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("fp").alias(f"fp_{c}")) for c in "ab"}
    judged = kept(pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "fp_a", "fp_b", "n_a", "n_b").mapInArrow(judge, "a long, b long, state int"))
    open_ = judged.where("state = 0").select("a", "b")
    wanted = open_.select(F.col("a").alias("id")).union(open_.select("b")).distinct()
    sets = kept(table.select("id", "shingles").join(wanted, "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("s")))
    settled = open_.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")
    roots = components(judged.where("state = 1").select("a", "b").union(settled))
    return nodes.select(F.col("id").alias("node"), "least"), roots


def one_of_similar(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, alike: float = ALIKE) -> DataFrame:
    """One row of each class of documents that are alike, directly or over others."""
    return first_of_each(docs, *classes(docs, text, key, size, alike), text, key)
