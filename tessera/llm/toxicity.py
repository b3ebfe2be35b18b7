"""Toxicity of texts as they were before obfuscation.

A noisy channel is inverted first: letters may have been written as other signs
(leetspeak), torn apart by spaces or signs, or repeated.  Every word that such a
channel may have touched spans a lattice of characters; the Viterbi path through
it, under a trigram character model of the corpus and the channel's costs, is
the restored text.  Words of plain letters without a threefold one have a single
path and stay.

Restored words and their beginnings are the features, with doubled letters as one.
Their counts over the training labels give a lexicon: the log odds of a toxic text
with a feature against those of any text, for features whose evidence chance among
all features explains none of.  Of near copies of one training text (same least
hash of five words and same label) the smallest key counts.  Where two or three
short plain words next to each other join to a word of the lexicon, a lattice
decides whether they were one word.  A document's evidence is its strongest
feature and ``REST`` of the others; lexicons of two halves of the training rows
each score the other half, and a logistic curve through those turns evidence into
the score, so no constant is chosen on held-out rows.

Labels come from training rows alone; the character model reads the texts of
training rows.  Labels, language, source and ids are never inputs of a score.

Edge cases: null and empty texts get the score of a text without evidence.  Of
several labels of one document the highest counts; null labels do not count.
Without training labels of both kinds every score is the same, below one half.
Repeated rows get equal scores; extra columns are ignored.  Memory follows 0.5 MB of
text or the longest text, and the lexicons (24 bytes an entry).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import LOWER, blocks, mix, pack_sorted, prefix, release, span_hash, unpack_sorted, utf8, windows, words
from ._chunks import buckets, sides
from ._links import kept, stored

#: Lengths of word beginnings that are scored besides whole words.
STEMS = (4, 5, 6)
#: What the features of a text besides its strongest count.
REST = 0.1
#: Letters of the pieces of torn words, and of a whole, at most.
PIECE, WHOLE = 5, 14
#: Bins of evidence, and its greatest value, that the logistic curve is fitted on.
BINS, MOST = 400, 40.0
#: Restored words that a worker remembers.
KNOWN = 50_000

#: What signs may stand for, and what each event of the channel costs in nats.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
COST = {"leet": 0.7, "drop": 0.5, "join": 0.3, "cut": 1.0, "repeat": 0.3, "double": 4.0}

_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}-_*~")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[97:123] = True
_PLAIN[128:] = True
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27
_N = 28


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    out = LOWER[data]
    second = np.flatnonzero(out[:-1] == 0xC3) + 1
    second = second[(out[second] >= 0x80) & (out[second] <= 0x9E) & (out[second] != 0x97)]
    out[second] += 0x20
    return out


class CharacterModel:
    """A trigram model of 26 letters, other letters and the rest."""

    def __init__(self, counts: np.ndarray):
        c3 = np.asarray(counts, float).reshape(_N, _N, _N)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + _N)
        p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
        p3 = (c3 + 20 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 20)
        self.log = np.log(p3).tolist()
        self.known: dict[str, str] = {}

    def restore(self, word: str) -> str:
        """The best path through the lattice of a word (lower case; inner spaces are gaps of torn words).

        Where it cuts the word, the best path without a cut follows, after a space.
        """
        if word not in self.known:
            if len(self.known) > KNOWN:
                self.known.clear()
            best = self._viterbi(word, True)
            whole = self._viterbi(word, False) if " " in best else best
            self.known[word] = best if whole == best else f"{best} {whole}"
        return self.known[word]

    def _options(self, word: str, cuts: bool):
        """Per place: what may have been meant, and its cost."""
        i = 0
        while i < len(word):
            j = i
            while j < len(word) and word[j] == word[i]:
                j += 1
            c, n = word[i], j - i
            if c.isalpha():
                once, more = (0.0, COST["double"]) if n == 1 else (COST["repeat"], COST["repeat"]) if n > 2 else (COST["double"], 0.0)
                yield ((c, once),) if n == 1 else ((c, once), (c + c, more))
            elif c in LEET and n < 3:
                meant = [(x, COST["leet"]) for x in LEET[c]] + [(x + x, COST["leet"]) for x in LEET[c] if n == 2]
                yield (*meant, *((((" ", COST["cut"]),) if cuts else ())))
            else:
                cost = COST["join"] if c == " " else COST["drop"]
                yield ((("", cost), (" ", cost if c == " " else COST["cut"])) if cuts else (("", cost),))
            i = j

    def _viterbi(self, word: str, cuts: bool) -> str:
        log = self.log
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self._options(word, cuts):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for text, cost in options:
                    x, y, s = a, b, score - cost
                    for c in text:
                        z = ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27
                        if not (z == 0 and y == 0):
                            s += log[x][y][z]
                            x, y = y, z
                    old = after.get((x, y))
                    if old is None or s > old[0]:
                        after[x, y] = (s, (path, text))
            best = after
        _, (_, path) = max(((s + log[a][b][0], (s, p)) for (a, b), (s, p) in best.items()), key=lambda t: t[0])
        parts = []
        while path is not None:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts))


def count_trigrams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    s = np.concatenate((_SYMBOL[lowered(data)], [0]))
    k = np.insert(s, off[:-1], 0)  # texts begin as if after a gap
    return np.bincount(k[:-2] * _N * _N + k[1:-1] * _N + k[2:], minlength=_N**3) if len(k) > 2 else np.zeros(_N**3, np.int64)


def squeezed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The bytes without letters that repeat the one before, and where words then begin and end."""
    stay = np.ones(len(data), bool)
    stay[1:] = (data[1:] != data[:-1]) | (data[1:] < 97) | (data[1:] > 122)
    stay[starts] = True
    at = np.concatenate(([0], np.cumsum(stay)))
    return data[stay], at[starts], at[ends]


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray):
    """Features (whole words and beginnings, doubled letters as one) of the words of a block: row and hash."""
    data, starts, ends = squeezed(data, starts, ends)
    sums = prefix(data)
    whole = span_hash(sums, starts, ends)
    _, first, place = np.unique(whole, return_index=True, return_inverse=True)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(heads, starts[first])
    edge = np.append(heads, len(data))
    out = [(doc, whole)]
    for k in STEMS:
        stop = edge[np.minimum(at + k, len(edge) - 1)]
        some = stop <= ends[first]
        h = np.zeros(len(first), np.uint64)
        h[some] = mix(span_hash(sums, starts[first][some], stop[some]) + np.uint64(k))
        mine = some[place]
        out.append((doc[mine], h[place[mine]]))
    docs, hashes = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    return docs, hashes


def _cores(data: np.ndarray, off: np.ndarray):
    starts, ends, doc = words(data, off)
    inner = np.flatnonzero(~_EDGE[data])
    if not len(inner):
        return starts[:0], ends[:0], doc[:0]
    a = inner[np.minimum(np.searchsorted(inner, starts), len(inner) - 1)]
    b = inner[np.maximum(np.searchsorted(inner, ends) - 1, 0)] + 1
    some = (a >= starts) & (b <= ends) & (a < b)
    return a[some], b[some], doc[some]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, plain: np.ndarray, model: CharacterModel, lexicon: np.ndarray):
    """Rows and hashes of words of the lexicon that two or three short plain words are the pieces of, as a lattice decides."""
    tight = np.zeros(len(data) + 1, np.int64)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside)[:-1] > 0
    tight[1:] = np.cumsum(inside)
    text, a, b = data[inside], tight[starts], tight[ends]
    text, a, b = squeezed(text, a, b)
    sums = prefix(text)
    short = plain & (ends - starts <= PIECE)
    rows, hashes = [], []
    for k in (2, 3):
        n = len(starts) - k + 1
        if n <= 0:
            continue
        some = (doc[:n] == doc[k - 1 :]) & np.logical_and.reduce([short[j : j + n] for j in range(k)]) & (b[k - 1 :] - a[:n] >= STEMS[0]) & (b[k - 1 :] - a[:n] <= WHOLE)
        i = np.flatnonzero(some)
        h = span_hash(sums, a[i], b[i + k - 1])
        hit = np.flatnonzero(lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h)
        for at, x in zip(i[hit].tolist(), h[hit], strict=True):
            pieces = " ".join(data[starts[j] : ends[j]].tobytes().decode("utf-8", "replace") for j in range(at, at + k))
            if " " not in model.restore(pieces):
                rows.append(doc[at])
                hashes.append(x)
    return np.array(rows, np.int64), np.array(hashes, np.uint64)


def features(data: np.ndarray, off: np.ndarray, model: CharacterModel, lexicon: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature hash of each restored word of a block (with repeats); with a lexicon, also of its words that plain pieces join to."""
    data = lowered(data)
    starts, ends, doc = _cores(data, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    strange = ~_PLAIN[data]
    strange[:-2] |= (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:]) & (data[:-2] < 128)
    sums = np.concatenate(([0], np.cumsum(strange)))
    odd = sums[ends] > sums[starts]
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    single = (heads[ends] - heads[starts] == 1) & ~odd | (ends - starts == 1)
    new = np.append(True, (single[1:] != single[:-1]) | (doc[1:] != doc[:-1]))
    run = np.cumsum(new) - 1
    torn = single & (np.bincount(run)[run] >= 3)
    lattice: dict[int, list[str]] = {}
    for i in np.flatnonzero(odd & ~torn).tolist():
        lattice.setdefault(int(doc[i]), []).append(model.restore(data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")))
    begin = np.flatnonzero(torn & new)
    close = np.append(np.flatnonzero(new)[1:], len(new))[run[begin]]
    for i, j in zip(begin.tolist(), close.tolist(), strict=True):
        letters = " ".join(data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in range(i, j))
        lattice.setdefault(int(doc[i]), []).append(model.restore(letters))
    plain = ~odd & ~torn
    docs, hashes = _hashed(data, starts[plain], ends[plain], doc[plain])
    if lexicon is not None and len(lexicon):
        d, h = _joined(data, starts, ends, doc, plain, model, lexicon)
        docs, hashes = np.concatenate((docs, d)), np.concatenate((hashes, h))
    if lattice:
        rows = np.array(list(lattice))
        texts = [" ".join(x).encode() for x in lattice.values()]
        more = np.frombuffer(b"".join(texts), np.uint8)
        a, b, d = words(more, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
        if len(a):
            d, h = _hashed(more, a, b, d)
            docs, hashes = np.concatenate((docs, rows[d])), np.concatenate((hashes, h))
    return docs, hashes


def held_out(key: str, folds: int):
    """Whether the CRC-32 of a key's text is divisible by ``folds`` (a null key counts as an empty one)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == 0


def fit_characters(docs: DataFrame, text: str = "text") -> CharacterModel:
    """The character model of all texts: counts are summed by the cluster."""

    def run(batches):
        total = np.zeros(_N**3, np.int64)
        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in blocks(off):
                total += count_trigrams(data[off[i] : off[j]], off[i : j + 1] - off[i])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["k", "n"])

    counts = np.zeros(_N**3)
    for r in docs.select(text).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r.k] = r.n
    return CharacterModel(counts)


_COUNTS = "bucket int, hashes binary, toxic binary, total binary, toxic_a binary, total_a binary"


def sketches(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The least hash of five consecutive words of each row: copies and most near copies have the same."""
    starts, ends, doc = words(data, off)
    h, at = windows(span_hash(prefix(data), starts, ends), doc, 5)
    out = mix(span_hash(prefix(data), off[:-1], off[1:]) | np.uint64(1 << 63))
    some = np.unique(doc[at])
    out[some] = np.uint64(2**64 - 1)
    np.minimum.at(out, doc[at], h)
    return out


def different(docs: DataFrame, train: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Of the labelled rows, one key of each group of near copies with one label."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([docs.schema[key], StructField("sketch", LongType())])

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in blocks(off):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sketches(data[off[i] : off[j]], off[i : j + 1] - off[i]).view(np.int64))], names=schema.names)

    rows = docs.select(key, text).mapInArrow(run, schema).join(train, key)
    return kept(rows.groupBy("sketch", label).agg(F.min(key).alias(key)).select(key, label).distinct())


def fit_lexicons(labelled: DataFrame, model: CharacterModel, base: float, text: str = "text", label: str = "toxic", half: str | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of telling features (ascending) and their log odds against the base: of all labelled rows, and of each half (column ``half``, 0 or 1)."""
    n = max(1, buckets(labelled) // 8)  # every task may have some for every bucket
    log = model.log

    def count(batches):
        own = CharacterModel.__new__(CharacterModel)
        own.log, own.known = log, {}
        held: list[tuple[np.ndarray, ...]] = []

        def merged():
            h = np.concatenate([x[0] for x in held])
            by = np.argsort(h, kind="stable")
            h = h[by]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            if not len(at):
                return h, *[np.zeros(0, np.uint32)] * 4
            return h[at], *(np.add.reduceat(np.concatenate([x[k] for x in held])[by], at).astype(np.uint32) for k in range(1, 5))

        def rows():
            h, *sums = merged()
            found, at = sides(h, n)
            cut = list(zip(at[:-1], at[1:], strict=True))
            columns = [[pack_sorted(h[i:j]) for i, j in cut], *[[x[i:j].tobytes() for i, j in cut] for x in sums]]
            return pa.RecordBatch.from_arrays([pa.array(found), *[pa.array(x, pa.binary()) for x in columns]], names=[x.split(" ")[0] for x in _COUNTS.split(", ")])

        for batch in batches:
            toxic = np.asarray(batch.column(1).fill_null(0), np.int64) > 0
            first = np.asarray(batch.column(2), np.int64) == 0
            data, off = utf8(batch.column(0))
            for i, j in blocks(off):
                doc, h = features(data[off[i] : off[j]], off[i : j + 1] - off[i], own)
                by = np.lexsort((doc, h))
                doc, h = doc[by], h[by]
                one = np.ones(len(h), bool)
                one[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = doc[one], h[one]
                if len(h):
                    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                    bad, side = toxic[i:j][doc], first[i:j][doc]
                    held.append((h[at], *(np.add.reduceat(x.astype(np.uint32), at) for x in (bad, np.ones(len(h)), bad & side, side))))
            if sum(len(x[0]) for x in held) > 2_000_000:
                held[:] = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield rows()
                    held.clear()
        if held:
            yield rows()
        own.known.clear()
        held.clear()
        release()

    def choose(bucket: pa.Table) -> pa.Table:
        h = np.concatenate([unpack_sorted(x, np.uint64) for x in bucket.column("hashes").to_pylist()])
        sums = [np.concatenate([np.frombuffer(x, np.uint32) for x in bucket.column(c).to_pylist()]).astype(np.int64) for c in ("toxic", "total", "toxic_a", "total_a")]
        by = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
        h, (t, m, ta, ma) = h[by][at], (np.add.reduceat(x[by], at) for x in sums)
        out = [pa.table({"part": pa.array([-1], pa.int32()), "h": pa.array([len(h)], pa.int64()), "odds": pa.array([0.0]), "evidence": pa.array([0.0])})]
        for part, (bad, every) in enumerate(((t, m), (ta, ma), (t - ta, m - ma))):
            share = bad / np.maximum(every, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                evidence = every * (np.nan_to_num(share * np.log(share / base)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - base))))
            some = (share > base) & (evidence > math.log(len(h)) + 3)  # at least; all features of the cluster raise the bound
            odds = np.log((bad[some] + 0.5) / (every[some] - bad[some] + 0.5)) - math.log(base / (1 - base))
            out.append(pa.table({"part": pa.array(np.full(some.sum(), part, np.int32)), "h": pa.array(h[some].view(np.int64)), "odds": pa.array(odds), "evidence": pa.array(evidence[some])}))
        return pa.concat_tables(out)

    rows = labelled.select(text, label, F.lit(0).alias("half") if half is None else F.col(half).cast("int").alias("half"))
    found = rows.mapInArrow(count, _COUNTS).groupBy("bucket").applyInArrow(choose, "part int, h long, odds double, evidence double").toArrow()
    part, h, odds, evidence = (found.column(c).to_numpy() for c in ("part", "h", "odds", "evidence"))
    enough = evidence > math.log(max(1, int(h[part < 0].sum()))) + 3
    out = []
    for k in range(3):
        some = np.flatnonzero(enough & (part == k) & (odds > 0))
        hashes = h[some].view(np.uint64)
        by = np.argsort(hashes)
        out.append((hashes[by], odds[some][by]))
    return out


def _sums(doc: np.ndarray, h: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The evidence of each of ``n`` rows: the strongest feature, and ``REST`` of the others."""
    hashes, odds = lexicon
    out = np.zeros(n)
    if len(h) and len(hashes):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[at] == h
        row, at = np.unique(np.stack((doc[hit], at[hit])), axis=1)
        np.add.at(out, row, REST * odds[at])
        best = np.zeros(n)
        np.maximum.at(best, row, odds[at])
        out += (1 - REST) * best
    return out


def evidence(docs: DataFrame, model: CharacterModel, lexicons: list[tuple[np.ndarray, np.ndarray]], text: str = "text", half: str | None = None) -> DataFrame:
    """Adds ``__x``, the evidence of every row by all training rows, and ``__y``, that by the half that its own (column ``half``, dropped) is not."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = [c for c in docs.columns if c != half]
    source = docs.select(*names, F.lit(0).alias("__half") if half is None else F.col(half).cast("int").alias("__half"))
    schema = StructType([*source.schema.fields[:-1], StructField("__x", DoubleType()), StructField("__y", DoubleType())])
    place = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((model.log, lexicons))

    def run(batches):
        log, parts = shared.value
        own = CharacterModel.__new__(CharacterModel)
        own.log, own.known = log, {}
        known = np.unique(np.concatenate([x for x, _ in parts]))
        for batch in batches:
            side = np.asarray(batch.column(len(names)), np.int64)
            data, off = utf8(batch.column(place))
            for i, j in blocks(off):
                doc, h = features(data[off[i] : off[j]], off[i : j + 1] - off[i], own, known)
                x, by_first, by_second = (_sums(doc, h, part, j - i) for part in parts)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:-1], pa.array(x), pa.array(np.where(side[i:j] == 0, by_second, by_first))], names=schema.names)
        own.known.clear()
        release()

    return source.mapInArrow(run, schema)


def curve(x: np.ndarray, bad: np.ndarray, total: np.ndarray) -> tuple[float, float]:
    """Level and slope of the logistic curve through counts of toxic and all texts by evidence (Newton steps, a weak prior, slope at least 0)."""
    a, b = -2.0, 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a + b * x)))
        w = total * p * (1 - p)
        g = np.array([(bad - total * p).sum() - 1e-2 * a, ((bad - total * p) * x).sum() - 1e-2 * b])
        h = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return min(a, -0.1), max(b, 0.0)


def calibrate(found: DataFrame, train: DataFrame, key: str, label: str = "toxic") -> tuple[float, float]:
    """The curve from evidence by the other half to labels, over all training rows (binned on the cluster)."""
    bins = F.round(F.least(F.col("__y"), F.lit(MOST)) * (BINS / MOST)).cast("int")
    counts = found.select(key, bins.alias("bin")).join(train.hint("merge"), key).groupBy("bin").agg(F.sum((F.col(label) > 0).cast("int")).alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    return curve(*(np.array([r[k] for r in counts], float) * s for k, s in ((0, MOST / BINS), (1, 1), (2, 1)))) if counts else (-2.0, 0.0)


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, key: str = "doc_id", text: str = "text", label: str = "toxic", into: str = "score", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Carried columns (default: all) and the score of every row, from labels of rows whose key's CRC-32 is not divisible by ``folds``."""
    carry = tuple(c for c in (docs.columns if carry is None else carry) if c != into)
    train = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key, folds)).groupBy(key).agg(F.max(label).alias(label))
    train = train.withColumn(label, (F.col(label) > 0).cast("int"))
    rate, n = train.agg(F.avg(label), F.count(F.lit(1))).head()
    own = docs.where(~held_out(key, folds)).select(key, text)
    if not n or rate in (0, 1):
        return docs.select(*carry, F.lit(0.1).alias(into))
    model = fit_characters(own, text)
    half = (F.floor(F.crc32(F.col(key).cast("string")) / folds) % 2).cast("int")
    texts = different(own, train, key, text, label)
    lexicons = fit_lexicons(own.join(texts.hint("merge"), key).select(text, label, half.alias("__half")), model, min(0.49, max(1e-6, rate)), text, label, "__half")
    wanted = [key, *(c for c in carry if c != key)]
    found = evidence(docs.select(*wanted, F.col(text).alias("__text"), F.coalesce(half, F.lit(0)).alias("__side")), model, lexicons, "__text", "__side").drop("__text")
    found = stored(found)
    a, b = calibrate(found, texts, key, label)
    return found.select(*carry, (1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("__x"))))).alias(into))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document, from labels outside its fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("doc_id",))
    return scored.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
