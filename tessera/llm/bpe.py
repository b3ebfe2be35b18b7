"""Byte-pair encoding and decoding over a pair occurrence index.

Each batch of texts is cut into pretokens.  Those it has not met before become
one array of byte tokens with neighbour links.  An index maps the rank of every
adjacent pair to all positions where the pair stands; active ranks are taken
in ascending order from a heap, all positions of a rank are merged at once, and
only the lists of pairs that touch a merge are updated.  Every merge makes a
token that later ranks alone can use (checked when a vocabulary is read), so one
ascending sweep gives what merging each word by itself would give.

Edge cases: null and empty texts have no tokens.  Strings of special tokens in
a text become their ids, as the tokenizers library does by default.  Repeated
rows give repeated results and extra columns are ignored.  Memory follows an
Arrow batch (or its longest text), plus a bounded table of known pretokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import release

#: Texts (characters) that share one pair index.
BATCH = 4 << 20
#: Pretokens that a worker remembers between batches.
KNOWN = 60_000


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write bytes as letters: printable ones as themselves, others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _splitter():
    """A function that cuts a text by the byte-level pretoken pattern.

    Letters and numbers are those of the tokenizers library's Unicode tables:
    of the regex module's, those that ``unicodedata`` knows.  The standard
    module ``re`` is several times faster and cuts alike unless a text has a
    character that its classes put elsewhere, or one beyond the basic plane; such
    texts take the other way.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    late = _class(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    letter, number = rf"[\p{{L}}--[{late}]]", rf"[\p{{N}}--[{late}]]"
    slow = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?(?:[^\s\p{{L}}\p{{N}}]|[{late}])+|\s+(?!\S)|\s+", regex.V1).findall
    fast = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall  # contractions before other signs; the rest begins apart
    differ = set()
    for ours, theirs in ((r"[^\W\d_]", letter), (r"\d", number), (r"\s", r"\s")):
        differ |= set(re.findall(ours, every)) ^ set(regex.findall(theirs, every, regex.V1))
    odd = re.compile(f"[{_class(c for c in differ if c < chr(0x10000))}\U00010000-\U0010FFFF]").search

    return lambda text: slow(text) if odd(text) else fast(text)


def _class(chars) -> str:
    """The inside of a character class for these characters."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans) or "\\U0010FFFF"


class _Places(dict):
    """Numbers its keys as they are looked up first."""

    def __missing__(self, key):
        self[key] = place = len(self)
        return place


class PairCodec:
    """Encodes and decodes with a byte-level BPE vocabulary file (its JSON text)."""

    def __init__(self, vocabulary: str | bytes):
        spec = json.loads(vocabulary)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["model"]["type"] != "BPE":
            raise ValueError("only byte-level BPE without a normaliser or prefix space is supported")
        letters, ids = _byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (1 + max([*ids.values(), *special.values()]))
        for name, k in ids.items():
            self.bytes[k] = bytes(letters[c] for c in name)
        for name, k in special.items():
            self.bytes[k] = name.encode()
        self.special = special
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.first = np.array([ids[a] for a, _ in merges], np.int64)
        self.second = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        born = np.full(len(self.bytes), -1, np.int64)
        born[self.made[::-1]] = np.arange(len(merges))[::-1]
        if len(np.unique(self.made)) != len(merges) or (born[self.first] >= np.arange(len(merges))).any() or (born[self.second] >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a token of a later merge")
        order = np.argsort(self.first << 32 | self.second)
        self.pairs, self.ranks = (self.first << 32 | self.second)[order], order.astype(np.int64)
        self.of_two = np.full(1 << 16, -1, np.int64)
        self.of_byte = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        two = self.rank(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))
        self.of_two[:] = two
        self.split = _splitter()
        self.known = _Places()
        self.forget(0)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of token ids, -1 where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each (distinct, non-empty) pretoken."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[0] = -1
        before[ends[:-1]] = -1
        alive = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(at: np.ndarray, r: np.ndarray) -> None:
            """Adds the pairs that start at these positions to the lists of their ranks."""
            found = r >= 0
            at, r = at[found], r[found]
            if not len(r):
                return
            if len(r) > 1:
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
                cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            else:
                cut = ()
            lo = 0
            for hi in [*cut, len(r)]:
                key = int(r[lo])
                if key in lists:
                    lists[key].append(at[lo:hi])
                else:
                    lists[key] = [at[lo:hi]]
                    heapq.heappush(heap, key)
                lo = hi

        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        at = np.flatnonzero(after >= 0)
        index(at, self.of_two[raw[at] << 8 | raw[at + 1]])
        while heap:
            rank = heapq.heappop(heap)
            parts = lists.pop(rank)
            at = np.concatenate(parts) if len(parts) > 1 else parts[0]
            a, b = self.first[rank], self.second[rank]
            at = at[alive[at] & (token[at] == a) & (after[at] >= 0)]
            at = at[token[after[at]] == b]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # of overlapping pairs the left one wins
                at = np.unique(at)
                joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            right = after[gone]
            token[at] = self.made[rank]
            alive[gone] = False
            after[at] = right
            inner = right >= 0
            before[right[inner]] = at[inner]
            left = before[at]
            touched = np.concatenate((left[left >= 0], at[inner]))
            if len(touched):
                index(touched, self.rank(token[touched], token[after[touched]]))
        out = token[alive].tolist()
        counts = np.cumsum(np.add.reduceat(alive.astype(np.int64), np.concatenate(([0], ends[:-1])))).tolist() if words else []
        return [tuple(out[i:j]) for i, j in zip([0, *counts[:-1]], counts, strict=True)]

    def pretokens(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self.split(text)
        return list(chain.from_iterable([p] if p in self.special else self.split(p) for p in self.special_split.split(text) if p))

    def forget(self, keep: int) -> None:
        """Drops all pretokens but the first ``keep``, among which are the frequent ones."""
        special = list(self.special.items())
        if keep < len(special):
            self.known = _Places((t, k) for k, (t, _) in enumerate(special))
            self.ids: list[tuple[int, ...]] = [(k,) for _, k in special]
            self.written: list[str] = [str(k) for _, k in special]
        else:
            self.known = _Places((t, k) for k, t in enumerate(list(islice(self.known, keep))))
            del self.ids[keep:], self.written[keep:]

    def places(self, texts: list[str]) -> list[list[int]]:
        """The pretokens of each text, as places in ``ids`` and ``written``."""
        if len(self.known) > KNOWN:
            self.forget(KNOWN // 2)
        find, before = self.known.__getitem__, len(self.known)
        out = [list(map(find, self.pretokens(t))) for t in texts]
        if len(self.known) > before:
            made = self.merge([w.encode() for w in islice(self.known, before, None)])
            self.ids += made
            self.written += [str(x)[1:-1].replace(" ", "").rstrip(",") for x in made]
        return out

    def tokens(self, places: list[int]) -> list[int]:
        return list(chain.from_iterable(map(self.ids.__getitem__, places)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text."""
        return [self.tokens(x) for x in self.places(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of token ids; special tokens are written out, broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, PairCodec] = {}


def codec(vocabulary: str | bytes) -> PairCodec:
    """A codec that the tasks of one worker share."""
    name = hashlib.sha256(vocabulary.encode() if isinstance(vocabulary, str) else vocabulary).hexdigest()
    if name not in _codecs:
        _codecs[name] = PairCodec(vocabulary)
    return _codecs[name]


def _texts(column: pa.Array):
    """Row ranges of a string column that share a pair index."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + BATCH, "right")))
        yield i, j
        i = j


def encode(docs: DataFrame, vocabulary: bytes, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the token ids of a text column, as array<int>; null texts have none."""
    return _mapped(docs, vocabulary, text, into, "array<int>", pa.list_(pa.int32()), lambda c, xs: c.encode(["" if x is None else x for x in xs]))


def decode(docs: DataFrame, vocabulary: bytes, ids: str = "ids", into: str = "text") -> DataFrame:
    """Adds the text of a column of token ids; null ids give an empty text."""
    return _mapped(docs, vocabulary, ids, into, "string", pa.string(), lambda c, xs: [c.decode(x or []) for x in xs])


def _mapped(docs: DataFrame, vocabulary: bytes, column: str, into: str, kind: str, arrow: pa.DataType, change) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.drop(into) if into != column else docs
    source_names = source.columns
    place, names = source_names.index(column), [*[c for c in docs.columns if c != into], into]

    def run(batches):
        c = codec(shared.value)
        for batch in batches:
            whole = batch.column(place)
            cuts = _texts(whole) if pa.types.is_string(whole.type) or pa.types.is_large_string(whole.type) else [(0, batch.num_rows)]
            for i, j in cuts:
                part = batch.slice(i, j - i)
                rest = [x for x, n in zip(part.columns, source_names, strict=True) if n != into]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(change(c, whole.slice(i, j - i).to_pylist()), arrow)], names=names)

    from pyspark.sql.types import StructType, _parse_datatype_string

    return source.mapInArrow(run, StructType([*[f for f in source.schema.fields if f.name != into], *_parse_datatype_string(f"`{into}` {kind}").fields]))


def digests(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """doc_id, token count and digests of ids and of the text decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        c = codec(shared.value)
        sha = hashlib.sha256
        for batch in batches:
            for i, j in _texts(batch.column(1)):
                rows = []
                for places in c.places([x or "" for x in batch.column(1).slice(i, j - i).to_pylist()]):
                    ids = c.tokens(places)
                    written = ",".join(map(c.written.__getitem__, places))
                    rows.append((len(ids), sha(written.encode()).hexdigest(), sha(c.decode(ids).encode()).hexdigest()))
                n, written, decoded = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        c.forget(KNOWN // 4)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, vocabulary: bytes, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns, ``n_tokens``, ``ids`` and whether decoding them gives the text again (``exact``)."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.select(F.col(text).alias("__in"), *carry)
    schema = StructType([*source.schema.fields[1:], *_parse_datatype_string("n_tokens long, ids array<int>, exact boolean").fields])

    def run(batches):
        c = codec(shared.value)
        c.forget(KNOWN // 4)  # a worker may have served other tasks
        for batch in batches:
            for i, j in _texts(batch.column(0)):
                part = batch.slice(i, j - i)
                texts = [x or "" for x in part.column(0).to_pylist()]
                ids = c.encode(texts)
                same = [c.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                off = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, off[-1])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(np.diff(off).astype(np.int64)), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.array(same)], names=schema.names)
        c.forget(0)
        release()

    return source.mapInArrow(run, schema)


def public_vocabulary(path: str | None = None) -> bytes:
    """The vocabulary file at a path on the driver, by default the public byte-level one."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


def op1_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Encodes and decodes every whole text of documents; ``vocabulary`` is the path of a vocabulary file on the driver."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary(vocabulary))
