"""Removal of repeated word windows with a log-structured fingerprint index.

A window is ``size`` consecutive words of one document.  Every word that lies in
a window which also occurs in an earlier document goes; windows are judged on
the input.  Fingerprints have 96 bits: 64 that order the runs and 32 of another
hash, of the words modulo a prime, that verify every match (of 2e13 windows, as
100 TB have, 0.003 false matches are expected).

Chunks of documents send the sorted hashes of their windows to buckets, which
are ranges of hashes.  A first merge-join, on 32 bits besides the range, leaves
windows that other chunks seem to have.  Those come to the bucket with all their
bits, in batches of documents by id: the bucket keeps a log of sorted immutable
runs of historical windows (``Runs``), merge-joins each batch with it, verifies
what matches, appends the batch as a new run and compacts runs of like size.
``RunLog`` keeps such runs of past calls as Parquet files: they are the oldest
history of the next call's buckets.

Edge cases: null and empty texts have no words and stay as they are.  Rows of
equal ``doc_id`` are never earlier than each other; a null ``doc_id`` is earlier
than none and later than none, so such rows stay whole and remove nothing.
Extra columns are kept, but for those named as the results.  Memory follows a
chunk (3 to 16 MB of text, or its longest document) and a bucket of packed hashes.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._blocks import check_hash, covered, pack_sorted, prefix, release, span_hash, unpack_sorted, utf8, windows, words
from ._chunks import chunked, column, sides
from ._links import kept

SIZE = 13
#: Batches of documents, by id, that a bucket takes one after another.
BATCHES = 16


class _Windows:
    """The windows of a chunk, by distinct 96-bit fingerprint."""

    def __init__(self, chunk: pa.Table, text: str, order: str, size: int, checks: bool = True):
        data, off = utf8(chunk.column(text))
        self.order = chunk.column(order).combine_chunks()
        known = ~np.asarray(self.order.is_null().to_numpy(zero_copy_only=False), bool)
        rank = self.order.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts, ends, self.doc = words(data, off)
        h = span_hash(prefix(data), starts, ends)
        self.h, self.at = windows(h, self.doc, size)
        self.g = np.zeros(0, np.uint32)
        if checks:  # of other word hashes, joined by another factor
            self.g = (windows(check_hash(data, off, starts, ends), self.doc, size, 0xA0761D6478BD642F)[0] >> np.uint64(32)).astype(np.uint32)
        self.n = len(chunk)
        full = known[self.doc[self.at]]
        if not full.all():
            self.h, self.g, self.at = self.h[full], self.g[full] if checks else self.g, self.at[full]
        self.rank = rank[self.doc[self.at]]

    def distinct(self):
        """Sorts windows by fingerprint and document: hashes, checks and smallest document of each fingerprint, and each window's place in them."""
        by = np.argsort(self.h, kind="stable")
        h, g, r = self.h[by], self.g[by], self.rank[by]
        tie = h[1:] == h[:-1]
        if tie.any():  # sort what is equal by check and document
            again = np.flatnonzero(np.append(tie, False) | np.append(False, tie))
            inner = np.lexsort((r[again], g[again], h[again]))
            by[again] = by[again][inner]
            h, g, r = self.h[by], self.g[by], self.rank[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        place = np.empty(len(h), np.int64)
        place[by] = np.cumsum(new) - 1
        return h[new], g[new], r[new], place


_RUNS = "bucket int, chunk int, hashes binary, checks binary, ranks binary"
_ANSWERS = "chunk int, bucket int, hashes binary, checks binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    release()  # the arrays of the group are done with
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], kinds[t]) for k, (n, t) in enumerate(fields)})


def _seen_elsewhere(bucket: pa.Table) -> pa.Table:
    """Of each chunk, the 32-bit hashes that another chunk or the log has too; of the log (chunk -1), the windows that some chunk seems to have."""
    chunks, b = column(bucket, "chunk"), int(bucket.column("bucket")[0].as_py())
    packed = bucket.column("hashes").to_pylist()
    runs = [unpack_sorted(x, np.uint32) if c >= 0 else np.unique(_short(unpack_sorted(x, np.uint64))) for c, x in zip(chunks, packed, strict=True)]
    every = np.sort(np.concatenate(runs))
    more = np.zeros(len(every), bool)
    more[1:] = every[1:] == every[:-1]
    more = np.unique(every[more])
    out = []
    for k, (c, run) in enumerate(zip(chunks, runs, strict=True)):
        if c >= 0:
            hit = run[_in(run, more)]
            if len(hit):
                out.append((int(c), b, pack_sorted(hit), b""))
        else:
            h = unpack_sorted(packed[k], np.uint64)
            hit = _in(_short(h), more)
            if hit.any():
                out.append((-1, b, pack_sorted(h[hit]), np.frombuffer(bucket.column("checks")[k].as_py(), np.uint32)[hit].tobytes()))
    return _rows(_ANSWERS, out)


def _short(h: np.ndarray) -> np.ndarray:
    """The middle 32 bits of a hash, of which its bucket has fixed few."""
    return (h >> np.uint64(8)).astype(np.uint32)


def _in(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(x), bool)
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x


def _ordered(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints ascending, each once."""
    by = np.lexsort((g, h))
    h, g = h[by], g[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return h[new], g[new]


class Runs:
    """A log of sorted immutable runs of fingerprints of one hash range, the oldest and longest first."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def has(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Merge-joins ascending fingerprints with every run, and verifies the matches."""
        out = np.zeros(len(h), bool)
        for old_h, old_g in self.runs:
            at = np.searchsorted(old_h, h)
            open_ = np.flatnonzero(~out)
            while len(open_):
                open_ = open_[at[open_] < len(old_h)]
                open_ = open_[old_h[at[open_]] == h[open_]]
                out[open_] |= old_g[at[open_]] == g[open_]
                open_ = open_[~out[open_]]
                at[open_] += 1
        return out

    def add(self, h: np.ndarray, g: np.ndarray) -> None:
        """Appends a run of ascending fingerprints; runs of like size are compacted."""
        if len(h):
            self.runs.append((h, g))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            (a, b), (c, d) = self.runs[-2:]
            self.runs[-2:] = [_ordered(np.concatenate((a, c)), np.concatenate((b, d)))]


def _settled(bounds: np.ndarray):
    def run(bucket: pa.Table) -> pa.Table:
        """Of each chunk, the fingerprints that an earlier document elsewhere has: batches go through the log of the bucket."""
        log, parts = Runs(), []
        for c, h, g, r in zip(*(bucket.column(n).to_pylist() for n in ("chunk", "hashes", "checks", "ranks")), strict=True):
            h, g = unpack_sorted(h, np.uint64), np.frombuffer(g, np.uint32)
            if c < 0:
                log.add(h, g)
            else:
                parts.append((h, g, np.frombuffer(r, np.int64), np.full(len(h), c, np.int32)))
        if not parts:
            return _rows(_ANSWERS, [])
        h, g, r, chunk = map(np.concatenate, zip(*parts, strict=True))
        batch = np.searchsorted(bounds, r, "left")
        by = np.lexsort((r, g, h, batch))
        h, g, r, chunk, batch = h[by], g[by], r[by], chunk[by], batch[by]
        lost = np.zeros(len(h), bool)
        edge = np.searchsorted(batch, np.arange(len(bounds) + 2))
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            if i == j:
                continue
            new = np.ones(j - i, bool)
            new[1:] = (h[i + 1 : j] != h[i : j - 1]) | (g[i + 1 : j] != g[i : j - 1])
            once = i + np.flatnonzero(new)
            group = np.cumsum(new) - 1
            lost[i:j] = log.has(h[once], g[once])[group] | (r[once][group] < r[i:j])
            log.add(h[once], g[once])
        by = np.flatnonzero(lost)
        by = by[np.lexsort((h[by], chunk[by]))]
        found, at = np.unique(chunk[by], return_index=True)
        b = int(bucket.column("bucket")[0].as_py())
        return _rows(_ANSWERS, [(int(c), b, pack_sorted(h[k]), g[k].tobytes()) for c, k in zip(found, np.split(by, at[1:]), strict=True)] if len(by) else [])

    return run


def find_repeats(docs: DataFrame, size: int = SIZE, text: str = "text", order: str = "doc_id", log: "RunLog | None" = None, edit=None, schema: StructType | None = None) -> DataFrame:
    """Adds ``n_words``, ``n_removed`` and ``kept`` (kept words, joined by one space; the text itself if none goes).

    ``edit`` may make other columns of each chunk: it gets the chunk, its words'
    rows and the mask of removed words, and returns a table of ``schema``.
    """
    docs = docs.drop(*{"n_words", "n_removed", "kept"} - {text, order})
    parts, n = chunked(docs, text, order)
    n = log.buckets if log else n
    bounds = np.array(docs.approxQuantile(order, [k / BATCHES for k in range(1, BATCHES)], 0.25 / BATCHES), np.float64)
    names = docs.columns

    def offer(chunk: pa.Table) -> pa.Table:
        h = np.unique(_Windows(chunk, text, order, size, False).h)
        found, at = sides(h, n)
        return _rows(_RUNS, [(int(b), chunk.column("__chunk")[0].as_py(), pack_sorted(np.unique(_short(h[i:j]))), b"", b"") for b, i, j in zip(found, at[:-1], at[1:], strict=True)])

    def claim(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(chunk) or not len(answer):
            return _rows(_RUNS, [])
        h, g, r, _ = _Windows(chunk, text, order, size).distinct()
        found, at = sides(h, n)
        where = {int(b): (i, j) for b, i, j in zip(found, at[:-1], at[1:], strict=True)}
        out = []
        for b, packed in zip(answer.column("bucket").to_pylist(), answer.column("hashes").to_pylist(), strict=True):
            i, j = where[b]
            hit = i + np.flatnonzero(_in(_short(h[i:j]), unpack_sorted(packed, np.uint32)))
            out.append((b, chunk.column("__chunk")[0].as_py(), pack_sorted(h[hit]), g[hit].tobytes(), r[hit].tobytes()))
        return _rows(_RUNS, out)

    def settle(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(chunk):
            return arrow_schema(out_schema).empty_table()
        w = _Windows(chunk, text, order, size)
        h, g, r, place = w.distinct()
        lost = np.zeros(len(h), bool)
        if len(answer):
            a = np.concatenate([unpack_sorted(x, np.uint64) for x in answer.column("hashes").to_pylist()])
            b = np.concatenate([np.frombuffer(x, np.uint32) for x in answer.column("checks").to_pylist()])
            both = np.lexsort((np.concatenate((np.ones(len(h), np.int8), np.zeros(len(a), np.int8))), np.concatenate((g, b)), np.concatenate((h, a))))
            mine = both < len(h)
            previous = np.roll(both, 1)
            pair = mine & (previous >= len(h))
            k, q = both[pair], previous[pair] - len(h)
            lost[k[(h[k] == a[q]) & (g[k] == b[q])]] = True
        gone = covered(w.at[lost[place] | (w.rank > r[place])], size, len(w.doc))
        return edit(chunk, w.doc, gone)

    def whole(chunk: pa.Table, doc: np.ndarray, gone: np.ndarray) -> pa.Table:
        total, lost, texts = tallies(chunk, text, doc, gone)
        cols = [chunk.column(c) for c in names]
        return pa.table([*cols, pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    out_schema = schema or StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    edit = edit or whole
    runs = parts.groupBy("__chunk").applyInArrow(offer, _RUNS)
    past = log.runs(docs.sparkSession) if log else None
    seen = (runs.unionByName(past) if past is not None else runs).groupBy("bucket").applyInArrow(_seen_elsewhere, _ANSWERS)
    if log:
        seen = kept(seen)  # the bucket's history and the chunks both read it
    claims = parts.groupBy("__chunk").cogroup(seen.withColumnRenamed("chunk", "__chunk").groupBy("__chunk")).applyInArrow(claim, _RUNS)
    if past is not None:
        claims = claims.unionByName(seen.where("chunk < 0").withColumn("ranks", F.lit(b"")))
    dominated = claims.groupBy("bucket").applyInArrow(_settled(bounds), _ANSWERS)
    return parts.groupBy("__chunk").cogroup(dominated.withColumnRenamed("chunk", "__chunk").groupBy("__chunk")).applyInArrow(settle, out_schema)


def arrow_schema(schema: StructType) -> pa.Schema:
    """What Arrow calls a table of this schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


_SPLIT = re.compile(rb"[^\x20\x09-\x0D]+").findall


def tallies(chunk: pa.Table, text: str, doc: np.ndarray, gone: np.ndarray):
    """Words, removed words and kept text of each row."""
    n = len(chunk)
    total, lost = np.bincount(doc, minlength=n), np.bincount(doc[gone], minlength=n)
    ends = np.cumsum(total)
    texts = []
    for k, raw in enumerate(chunk.column(text).to_pylist()):
        texts.append(raw if not lost[k] else b" ".join(compress(raw.encode().split(), ~gone[ends[k] - total[k] : ends[k]])).decode())
    return total, lost, texts


class RunLog:
    """Window fingerprints of past batches, as Parquet files below ``path`` (a path that all executors share).

    ``add`` removes from a batch what it or the past has seen before and then
    appends the batch's windows as a new immutable run; ``compact`` merges all
    runs into one.  History counts as earlier than every new document.  The list
    of runs is a new file each time, renamed into place when it is whole, so a job
    that dies half-way leaves the log as it was.  ``buckets`` holds for the log's
    life; choose it by the history expected (64 MB of text each).
    """

    def __init__(self, spark, path: str, buckets: int = 64, size: int = SIZE):
        self.spark, self.path, self.buckets, self.size = spark, path.rstrip("/"), buckets, size
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self) -> int:
        found = self._fs.globStatus(self._path(f"{self.path}/list-*.json"))
        return max((int(f.getPath().getName()[5:-5]) for f in found or ()), default=0)

    def names(self) -> list[str]:
        last = self._version()
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/list-{last:08d}.json").collect())) if last else []

    def _list(self, names: list[str]) -> None:
        draft, final = self._path(f"{self.path}/draft.json"), self._path(f"{self.path}/list-{self._version() + 1:08d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(names).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"cannot write {final}")

    def runs(self, spark) -> DataFrame | None:
        names = self.names()
        if not names:
            return None
        return spark.read.parquet(*[f"{self.path}/{n}" for n in names]).select("bucket", F.lit(-1).alias("chunk"), "hashes", "checks", F.lit(None).cast("binary").alias("ranks"))

    def add(self, docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
        """The batch as ``find_repeats`` gives it, read from storage; its windows join the log."""
        n, size, name = self.buckets, self.size, f"run-{self._version()}"
        find_repeats(docs, size, text, order, self).write.mode("overwrite").parquet(f"{self.path}/batch-{name}")

        def run(chunk: pa.Table) -> pa.Table:
            h, g, _, _ = _Windows(chunk, text, order, size).distinct()
            found, at = sides(h, n)
            return _rows(_RUNS, [(int(b), 0, pack_sorted(h[i:j]), g[i:j].tobytes(), b"") for b, i, j in zip(found, at[:-1], at[1:], strict=True)])

        _merged(chunked(docs, text, order)[0].groupBy("__chunk").applyInArrow(run, _RUNS)).write.mode("overwrite").parquet(f"{self.path}/{name}")
        self._list([*self.names(), name])
        return self.spark.read.parquet(f"{self.path}/batch-{name}")

    def compact(self) -> None:
        """Merges all runs into one sorted run without repeats."""
        old = self.names()
        if len(old) > 1:
            name = f"compact-{self._version()}"
            _merged(self.runs(self.spark)).write.mode("overwrite").parquet(f"{self.path}/{name}")
            self._list([name])


def _merged(runs: DataFrame) -> DataFrame:
    def merge(bucket: pa.Table) -> pa.Table:
        h = np.concatenate([unpack_sorted(x, np.uint64) for x in bucket.column("hashes").to_pylist()])
        g = np.concatenate([np.frombuffer(x, np.uint32) for x in bucket.column("checks").to_pylist()])
        h, g = _ordered(h, g)
        return _rows(_RUNS, [(bucket.column("bucket")[0].as_py(), -1, pack_sorted(h), g.tobytes(), b"")])

    return runs.groupBy("bucket").applyInArrow(merge, _RUNS)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that an earlier document has are removed; digests of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    schema = StructType([StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])

    def digest(chunk: pa.Table, doc: np.ndarray, gone: np.ndarray) -> pa.Table:
        total, lost, texts = tallies(chunk, "text", doc, gone)
        sha = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts]
        return pa.table([chunk.column("doc_id"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha)], names=schema.names)

    return find_repeats(docs, edit=digest, schema=schema)


OP5_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, i, array_to_string(ws[i:i+12], ' ') as s
      from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d where len(ws) >= 13)),
m as (select doc_id, i, min(doc_id) over (partition by s) as first_doc from g),
p as (select distinct doc_id, unnest(range(i, i + 13)) as k from m where first_doc < doc_id),
r as (select doc_id, count(*) as n, list(k) as ks from p group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(r.n, 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(case when r.ks is null then ws else
    list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: not list_contains(r.ks, x[2])), lambda x: x[1]) end, ' '), '')) as kept_sha256
from d left join r using (doc_id)
"""
