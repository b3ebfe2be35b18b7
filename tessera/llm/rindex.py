"""Removal of long repeated byte strings with run-length compressed indexes.

Every byte that lies in a ``size``-byte string which also starts in an earlier
document goes.  All such strings hold, at the same place, the same anchor: the
least hash among the ``GRAM``-byte strings inside (the first, if equal).  Chunks
of documents tell buckets of anchors which they have; stretches of text around
anchors that more than one document has go to the anchor's bucket, equal ones of
a chunk once, with their smallest document.

A bucket halves its distinct stretches by their smallest document.  It builds a
run-length compressed Burrows-Wheeler index of the earlier half (runs of the
transform, with text positions sampled at run ends) and streams the matching
statistics of the later half through it, right to left: where at least ``size``
bytes match, an earlier document has them.  Inside a half, rows of its transform
that share ``size`` symbols are a block, and the block's smallest document decides.

Edge cases: null and empty texts have no bytes and stay as they are; texts
shorter than ``size`` stay whole.  Rows of equal ``doc_id`` are never earlier
than each other; a null ``doc_id`` is neither earlier nor later than another.
Extra columns are kept, but for those named as the results.  Inside a chunk equal stretches are told by 64-bit
hashes.  Memory follows a chunk (3 to 16 MB of text, or its longest document)
and the distinct stretches of a bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ._blocks import covered, mix, pack_sorted, powers, prefix, span_hash, unpack_sorted, utf8
from ._chunks import chunked, column, sides
from .repeats import _in, _short, arrow_schema

SIZE, GRAM = 50, 20


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of texts, each ended by a separator of its own."""

    def __init__(self, texts: np.ndarray, off: np.ndarray):
        n, k = len(texts) + len(off) - 1, len(off) - 1
        used = np.flatnonzero(np.bincount(texts, minlength=256))
        self.code = np.full(256, -1, np.int64)
        self.code[used] = np.arange(1, len(used) + 1)
        ends = off[1:] + np.arange(k)
        symbol = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbol[inside] = self.code[texts]
        self.symbol, self.text_of = symbol, np.repeat(np.arange(k), np.diff(off) + 1)
        self.rest = ends[self.text_of] - np.arange(n)
        self._sort(int(len(used)).bit_length())
        last = symbol[self.sa - 1]
        self.run_start = np.flatnonzero(np.append(True, last[1:] != last[:-1]))
        self.run_symbol = last[self.run_start]
        stop = np.append(self.run_start[1:], n)
        self.first_sample, self.last_sample = self.sa[self.run_start], self.sa[stop - 1]
        self.run_stop = stop
        marks = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        marks[self.run_start] = 1
        self.marks = np.packbits(marks, bitorder="little").view(np.uint64)
        self.marked = np.cumsum(np.bitwise_count(self.marks), dtype=np.int64) - np.bitwise_count(self.marks)
        by = np.lexsort((self.run_start, self.run_symbol))
        sizes = (stop - self.run_start)[by]
        before = np.cumsum(sizes) - sizes
        self.before = np.empty(len(by), np.int64)
        self.before[by] = before  # where LF sends a run's first row
        self.by_symbol = self.run_symbol[by] * len(by) + by

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def _sort(self, bits: int) -> None:
        """The suffix array by prefix doubling; ties at a separator fall by position.  Keeps the ranks of each depth."""
        n, symbol, rest = len(self.symbol), self.symbol, self.rest
        depth, key = 1, symbol
        while 2 * depth * bits <= 62:
            more = np.zeros(n, np.int64)
            more[: n - depth] = np.where(rest[: n - depth] > depth, key[depth:], 0) if depth < n else 0
            key = key << bits * depth | more
            depth *= 2
        sa = np.argsort(key)
        key = key[sa]
        new = np.append(True, key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[sa] = head
        self.depths: list[int] = [depth]
        self.ranks: list[np.ndarray] = [rank.astype(np.int32)]
        longest = int(rest.max(initial=0))
        while depth <= longest:
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            at = sa[slots]
            more = rest[at] > depth
            second = np.zeros(len(at), np.int64)
            second[more] = rank[at[more] + depth] + 1
            key = head[slots] << 32 | second
            by = np.argsort(key)
            sa[slots], key = at[by], key[by]
            new[slots] = np.append(True, key[1:] != key[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank = rank.copy()
            rank[sa[slots]] = head[slots]
            depth *= 2
            self.depths.append(depth)
            self.ranks.append(rank.astype(np.int32))
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)  # equal up to their separators
        sa[slots] = sa[slots][np.argsort(head[slots] << 32 | sa[slots])]
        self.sa = sa

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at two arrays of positions share."""
        n, a, b = len(self.symbol), a.copy(), b.copy()
        bound = np.minimum(self.rest[a], self.rest[b])
        out = np.zeros(len(a), np.int64)
        for depth, rank in zip(reversed(self.depths), reversed(self.ranks), strict=True):
            while True:
                go = (out < bound) & (rank[np.minimum(a + out, n - 1)] == rank[np.minimum(b + out, n - 1)])
                if not go.any():
                    break
                out[go] += depth
        out = np.minimum(out, bound)
        for _ in range(self.depths[0]):
            go = (out < bound) & (self.symbol[np.minimum(a + out, n - 1)] == self.symbol[np.minimum(b + out, n - 1)])
            if not go.any():
                break
            out[go] += 1
        return out

    def step(self, row: np.ndarray, at: np.ndarray, length: np.ndarray, symbol: np.ndarray):
        """Extends matches one symbol to the left: rows, text positions and lengths; symbols below 1 match nothing."""
        word = row >> 6
        run = self.marked[word] + np.bitwise_count(self.marks[word] & ((np.uint64(2) << (row & 63).astype(np.uint64)) - np.uint64(1))) - 1  # runs that start up to a row
        ok = self.run_symbol[run] == symbol
        jump = np.flatnonzero(~ok & (symbol > 0))
        if len(jump):
            row, at, length, r = row.copy(), at.copy(), length.copy(), self.runs
            want = np.searchsorted(self.by_symbol, symbol[jump] * r + run[jump])
            up, down = self.by_symbol[np.maximum(want - 1, 0)], self.by_symbol[np.minimum(want, r - 1)]
            has_up, has_down = (want > 0) & (up // r == symbol[jump]), (want < r) & (down // r == symbol[jump])
            up, down = up % r, down % r
            share_up = np.where(has_up, np.minimum(length[jump], self.same(at[jump], self.last_sample[up])), -1)
            share_down = np.where(has_down, np.minimum(length[jump], self.same(at[jump], self.first_sample[down])), -1)
            above = share_up >= share_down
            run[jump] = np.where(above, up, down)
            row[jump] = np.where(above, self.run_stop[up] - 1, self.run_start[down])
            at[jump] = np.where(above, self.last_sample[up], self.first_sample[down])
            length[jump] = np.where(above, share_up, share_down)
        hit = symbol > 0
        return (
            np.where(hit, self.before[run] + row - self.run_start[run], row),
            np.where(hit, at - 1, at),
            np.where(hit, length + 1, 0),
        )

    def matching_statistics(self, texts: np.ndarray, off: np.ndarray, need: int = 0):
        """For every byte of the texts, the length of the longest match that starts there and the row of one such suffix.

        A text is left (zeros for the rest) where no match of ``need`` bytes can start any more.
        """
        lengths, rows = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        left = np.diff(off)
        some = left > 0
        where, left = off[1:][some] - 1, left[some] - 1
        row, at, length = np.zeros(len(where), np.int64), np.full(len(where), self.sa[0]), np.zeros(len(where), np.int64)
        while len(where):
            row, at, length = self.step(row, at, length, self.code[texts[where]])
            lengths[where], rows[where] = length, row
            on = (left > 0) & (length + left >= need)
            if not on.all():
                where, left, row, at, length = where[on], left[on], row[on], at[on], length[on]
            where, left = where - 1, left - 1
        return lengths, rows

    def blocks(self, size: int) -> np.ndarray:
        """The number of each row's block: rows are together if they share ``size`` symbols."""
        depth, rank = max(((d, r) for d, r in zip(self.depths, self.ranks, strict=True) if d <= size), key=lambda x: x[0], default=(0, None))
        a, b = self.sa[1:], self.sa[:-1]
        if not depth:
            return np.cumsum(np.append(True, self.same(a, b) < size)) - 1
        full = (self.rest[a] >= size) & (self.rest[b] >= size)
        together, done = full.copy(), 0
        while done < size:
            shift = min(done, size - depth)
            k = np.flatnonzero(together)
            together[k] = rank[a[k] + shift] == rank[b[k] + shift]
            done = shift + depth
        return np.cumsum(np.append(True, ~together)) - 1


class _Stretches:
    """The stretches of a chunk: for each run of windows with one anchor, the bytes they span."""

    def __init__(self, chunk: pa.Table, text: str, order: str, size: int, gram: int):
        self.data, self.off = utf8(chunk.column(text))
        known = chunk.column(order).combine_chunks()
        ranks = known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, off, n = self.data, self.off, len(self.data)
        wide = size - gram + 1
        self.sums = prefix(data)
        if n < size:
            self.start = self.stop = self.doc = self.rank = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        _, down = powers(n + 1)
        h = (self.sums[gram:] - self.sums[:-gram]) * down[: n - gram + 1]
        low = np.uint64((1 << 32) - 1)  # as wide in every chunk, so that equal windows get equal anchors
        key = h & ~low
        key |= np.arange(len(key), dtype=np.uint64)
        have = 1
        while 2 * have <= wide:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < wide:
            key = np.minimum(key[: len(key) - (wide - have)], key[wide - have :])
        key &= low
        place = key.astype(np.int64)
        ends = off[1:][np.diff(off) > 0]
        begins = off[:-1][np.diff(off) > 0]
        bad = np.zeros(n + 1, np.int64)  # windows that would cross the end of their document
        np.add.at(bad, np.maximum(begins, ends - size + 1), 1)
        np.add.at(bad, ends, -1)
        fine = np.cumsum(bad)[: len(place)] == 0
        if known.null_count:
            doc = np.searchsorted(off, np.arange(len(place)), "right") - 1
            fine &= ~np.asarray(known.is_null().to_numpy(zero_copy_only=False), bool)[doc]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (fine[1:] != fine[:-1])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(place))
        take = fine[start]
        self.start, self.stop = start[take], stop[take]
        self.anchor = mix(h[place[self.start]])
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.rank = ranks[self.doc]

    def shared(self) -> np.ndarray:
        """Which stretches have an anchor that more than one document of the chunk has."""
        by = np.lexsort((self.rank, self.anchor))
        a, r = self.anchor[by], self.rank[by]
        first = np.ones(len(by), bool)
        first[1:] = a[1:] != a[:-1]
        group = np.cumsum(first) - 1
        lo = np.flatnonzero(first)
        many = np.minimum.reduceat(r, lo) != np.maximum.reduceat(r, lo) if len(lo) else np.zeros(0, bool)
        out = np.empty(len(by), bool)
        out[by] = many[group]
        return out


_RUNS = "bucket int, chunk int, anchors binary, sizes binary, ranks binary, text binary"
_SEEN = "chunk int, bucket int, anchors binary, names binary, masks binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], kinds[t]) for k, (n, t) in enumerate(fields)})


def _spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of spans, one after another."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


def _elsewhere(bucket: pa.Table) -> pa.Table:
    """Of each chunk, the anchors that another chunk has too."""
    chunks = column(bucket, "chunk")
    runs = [unpack_sorted(b, np.uint32) for b in bucket.column("anchors").to_pylist()]
    every = np.sort(np.concatenate(runs))
    more = np.zeros(len(every), bool)
    more[1:] = every[1:] == every[:-1]
    more = every[more]
    out = []
    for c, run in zip(chunks, runs, strict=True):
        hit = run[_in(run, more)]
        if len(hit):
            out.append((int(c), int(bucket.column("bucket")[0].as_py()), pack_sorted(hit), b"", b""))
    return _rows(_SEEN, out)


def _matched(size: int):
    def run(bucket: pa.Table) -> pa.Table:
        """Of each chunk, its stretches with windows that an earlier document has, as bits from the first window."""
        sizes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in bucket.column("sizes").to_pylist()]
        owner = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])
        length = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        rank = np.concatenate([np.frombuffer(x, np.int64) for x in bucket.column("ranks").to_pylist()])
        data = np.frombuffer(b"".join(bucket.column("text").to_pylist()), np.uint8)
        off = np.concatenate(([0], np.cumsum(length)))
        name = span_hash(prefix(data), off[:-1], off[1:])
        # equal stretches of several chunks: one each, with its smallest document
        width = int(length.max(initial=1))
        square = np.zeros((len(length), width + 1), np.uint8)
        square[np.repeat(np.arange(len(length)), length), _spans(length, np.zeros(len(length), np.int64))] = data
        square[:, width] = length
        _, where, place = np.unique(square.view(f"V{width + 1}").ravel(), return_index=True, return_inverse=True)
        del square
        least = np.full(len(where), np.iinfo(np.int64).max)
        np.minimum.at(least, place, rank)
        size_of = length[where]
        part = np.concatenate(([0], np.cumsum(size_of)))
        text = data[_spans(size_of, off[:-1][where])]
        found = np.full(len(text), np.iinfo(np.int64).max)
        late = least >= np.sort(least)[len(least) // 2] if len(least) else np.zeros(0, bool)
        earlier = None
        for half in (np.flatnonzero(~late), np.flatnonzero(late)):
            if not len(half):
                continue
            at = _spans(size_of[half], part[:-1][half])
            cut = np.concatenate(([0], np.cumsum(size_of[half])))
            if earlier is not None:
                matched, _ = earlier.matching_statistics(text[at], cut, size)
                found[at[matched >= size]] = np.iinfo(np.int64).min
            index = RunLengthIndex(text[at], cut)
            block = index.blocks(size)
            smallest = np.minimum.reduceat(least[half][index.text_of[index.sa]], np.flatnonzero(np.append(True, block[1:] != block[:-1])))
            own = np.empty(len(index.sa), np.int64)
            own[index.sa] = smallest[block]
            inside = index.symbol > 0
            found[at] = np.minimum(found[at], np.where(index.rest[inside] >= size, own[inside], np.iinfo(np.int64).max))
            earlier = index
        n_windows = length - size + 1
        at = _spans(n_windows, part[:-1][place])
        lost = found[at] < np.repeat(rank, n_windows)
        bit = np.uint64(1) << _spans(n_windows, np.zeros(len(length), np.int64)).astype(np.uint64)
        begin = np.cumsum(n_windows) - n_windows
        mask = np.add.reduceat(np.where(lost, bit, np.uint64(0)), begin) if len(begin) else np.zeros(0, np.uint64)
        out = []
        some = np.flatnonzero(mask > 0)
        some = some[np.lexsort((name[some], owner[some]))]
        chunks, b = column(bucket, "chunk"), int(bucket.column("bucket")[0].as_py())
        for mine in np.split(some, np.flatnonzero(owner[some][1:] != owner[some][:-1]) + 1) if len(some) else ():
            out.append((int(chunks[owner[mine[0]]]), b, b"", pack_sorted(name[mine]), mask[mine].tobytes()))
        return _rows(_SEEN, out)

    return run


def find_long_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, text: str = "text", order: str = "doc_id", edit=None, schema: StructType | None = None) -> DataFrame:
    """Adds ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes; a byte sequence, since cuts can fall inside a character)."""
    if not 1 <= gram <= size or size - gram + 1 > 64 or 2 * size - gram > 255:
        raise ValueError("gram must be at most size and leave at most 64 places and 255 bytes")
    docs = docs.drop(*{"n_bytes", "n_removed", "n_spans", "kept"} - {text, order})
    (parts, n), names = chunked(docs, text, order), docs.columns

    def offer(chunk: pa.Table) -> pa.Table:
        h = np.unique(_Stretches(chunk, text, order, size, gram).anchor)
        found, at = sides(h, n)
        return _rows(_RUNS, [(int(b), chunk.column("__chunk")[0].as_py(), pack_sorted(np.unique(_short(h[i:j]))), b"", b"", b"") for b, i, j in zip(found, at[:-1], at[1:], strict=True)])

    def claim(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(chunk):
            return _rows(_RUNS, [])
        s = _Stretches(chunk, text, order, size, gram)
        wanted = s.shared()
        by = np.argsort(s.anchor, kind="stable")
        found, at = sides(s.anchor[by], n)
        where = {int(b): (i, j) for b, i, j in zip(found, at[:-1], at[1:], strict=True)}
        for b, packed in zip(answer.column("bucket").to_pylist(), answer.column("anchors").to_pylist(), strict=True):
            mine = by[slice(*where[b])]
            wanted[mine[_in(_short(s.anchor[mine]), unpack_sorted(packed, np.uint32))]] = True
        start, stop = s.start[wanted], s.stop[wanted] + size - 1
        name = span_hash(s.sums, start, stop)
        rank, anchor = s.rank[wanted], s.anchor[wanted]
        by = np.lexsort((rank, name))  # the first of equal stretches has the smallest document
        by = by[np.append(True, name[by][1:] != name[by][:-1])] if len(by) else by
        by = by[np.argsort(anchor[by], kind="stable")]
        found, at = sides(anchor[by], n)
        length = stop - start
        out = []
        for b, i, j in zip(found, at[:-1], at[1:], strict=True):
            k = by[i:j]
            out.append((int(b), chunk.column("__chunk")[0].as_py(), b"", length[k].astype(np.uint8).tobytes(), rank[k].tobytes(), s.data[_spans(length[k], start[k])].tobytes()))
        return _rows(_RUNS, out)

    def settle(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(chunk):
            return arrow_schema(out_schema).empty_table()
        s = _Stretches(chunk, text, order, size, gram)
        name = span_hash(s.sums, s.start, s.stop + size - 1)
        by = np.lexsort((s.rank, name))
        first = np.ones(len(by), bool)
        first[1:] = name[by][1:] != name[by][:-1]
        least = np.empty(len(by), np.int64)
        least[by] = s.rank[by][first][np.cumsum(first) - 1] if len(by) else 0
        gone = np.zeros(len(s.data), bool)
        whole = s.rank > least
        width = (s.stop - s.start)[whole]
        at = [_spans(width, s.start[whole])]
        if len(answer):
            names_ = np.concatenate([unpack_sorted(x, np.uint64) for x in answer.column("names").to_pylist()])
            masks = np.concatenate([np.frombuffer(x, np.uint64) for x in answer.column("masks").to_pylist()])
            order_ = np.argsort(names_)
            names_, masks = names_[order_], masks[order_]
            some = np.flatnonzero(~whole & _in(name, names_))
            mask = masks[np.searchsorted(names_, name[some])]
            for b in range(size - gram + 1):
                at.append(s.start[some[(mask >> np.uint64(b)) & np.uint64(1) > 0]] + b)
        gone = covered(np.concatenate(at), size, len(s.data))
        return edit(chunk, s.data, s.off, gone)

    def kept(chunk: pa.Table, data: np.ndarray, off: np.ndarray, gone: np.ndarray) -> pa.Table:
        total, lost, spans, texts = tallies(data, off, gone)
        return pa.table([*[chunk.column(c) for c in names], pa.array(total), pa.array(lost), pa.array(spans), pa.array(texts, pa.binary())], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    out_schema = schema or StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")], StructField("kept", BinaryType())])
    edit = edit or kept
    seen = parts.groupBy("__chunk").applyInArrow(offer, _RUNS).groupBy("bucket").applyInArrow(_elsewhere, _SEEN)
    claims = parts.groupBy("__chunk").cogroup(seen.withColumnRenamed("chunk", "__chunk").groupBy("__chunk")).applyInArrow(claim, _RUNS)
    found = claims.groupBy("bucket").applyInArrow(_matched(size), _SEEN)
    return parts.groupBy("__chunk").cogroup(found.withColumnRenamed("chunk", "__chunk").groupBy("__chunk")).applyInArrow(settle, out_schema)


def tallies(data: np.ndarray, off: np.ndarray, gone: np.ndarray):
    """Bytes, removed bytes, removed runs and what is left of each row."""
    sums = np.concatenate(([0], np.cumsum(gone)))
    lost = sums[off[1:]] - sums[off[:-1]]
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    edge = off[:-1][off[:-1] < len(gone)]
    begin[edge] = gone[edge]
    sums = np.concatenate(([0], np.cumsum(begin)))
    spans = sums[off[1:]] - sums[off[:-1]]
    left = [data[i:j][~gone[i:j]].tobytes() if k else data[i:j].tobytes() for i, j, k in zip(off[:-1], off[1:], lost, strict=True)]
    return np.diff(off), lost, spans, left


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that an earlier document has are removed; digests of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    schema = StructType([*[StructField(c, LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")], StructField("kept_sha256", StringType())])

    def digest(chunk: pa.Table, data: np.ndarray, off: np.ndarray, gone: np.ndarray) -> pa.Table:
        total, lost, spans, left = tallies(data, off, gone)
        return pa.table([chunk.column("doc_id"), pa.array(total), pa.array(lost), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in left])], names=schema.names)

    return find_long_repeats(docs, edit=digest, schema=schema)
