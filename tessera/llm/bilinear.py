"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

A token's class is one of the most frequent words by itself, or one of
``SUFFIXES`` classes of the other words by their last three bytes, or the end of
a text.  The frequent words are ``TOP`` up to ``GROWS`` bytes of text, and grow with
the sixth root of the bytes beyond.  The model scores a class after the two before
it: the sum of a vector for the class before and one for the class two before (which
``FAR`` groups of like vectors tell apart), times the target's vector, plus the
target's bias.  It is trained in NumPy in two passes: on the counts of
all adjacent classes of all training texts, which the cluster sums (noise-contrastive
estimation in expectation), and then, for both places, by noise-contrastive
estimation with sampled noise on every triple of all training texts: texts are dealt
by a hash into shares of about ``MOST`` bytes, each share trains a copy of the model
by one pass over its triples, and the copies are averaged by numbers of triples.
The cluster then sums the exponentials of all targets' scores once for every pair of a
group and a class before, which normalises the log-probabilities of all texts.  A word within its class has its
smoothed relative frequency, with a share for unknown words, so the
probabilities of all tokens add up to one.

Word counts are exact over all training texts.  Chunks of documents send their
distinct words with counts to buckets of words, which answer with the sums.

Edge cases: null and empty texts have the end as their only token.  A null key
counts as an empty one in the choice of folds.  Without training texts all
classes are equally likely.  Repeated rows count as often as they occur.  Words
are told apart by 54 bits of a hash and the suffix class.  Memory follows a chunk and a
bucket of words, and the square of the classes on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import LOWER, blocks, mix, pack_sorted, prefix, release, span_hash, unpack_sorted, utf8, words
from ._chunks import MOST, chunked, sides
from ._links import kept
from .toxicity import held_out

TOP, SUFFIXES, WIDTH, NOISE = 1024, 1024, 24, 10
#: Bytes of text from which the frequent words grow.
GROWS = 1 << 29
#: Groups of classes (by their vectors) that are told apart two places before.
FAR = 128
#: Contexts whose scores of all targets are worked on at a time, and whose scores of sampled noise are: few, so that they stay in the cache.
PAIRS, ROWS = 128, 1024
#: Contexts whose pair counts are sent together.
GROUP = 64
#: The share of an unseen word, in counts.
SMOOTH = 0.1
_LOW = np.uint64(SUFFIXES - 1)
_END_KEY = mix(np.array([0xE17D], np.uint64))[0] & ~_LOW


def tokens(data: np.ndarray, off: np.ndarray):
    """Keys and rows of the words of a block; a key's low bits are the suffix class."""
    data = LOWER[data]
    starts, ends, doc = words(data, off)
    sums = prefix(data)
    tail = span_hash(sums, np.maximum(starts, ends - 3), ends) >> np.uint64(40)
    return span_hash(sums, starts, ends) & ~_LOW | tail & _LOW, doc


def _add(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows at places that may repeat."""
    at = at.astype(np.min_scalar_type(len(out)))  # places of two bytes are sorted by counting
    by = np.argsort(at, kind="stable")
    at = at[by]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out[at[first]] += np.add.reduceat(rows.take(by, axis=0), first, axis=0)


def _ones(x: np.ndarray) -> np.ndarray:
    """Rows with a one behind each, which takes up a bias."""
    out = np.ones((len(x), x.shape[1] + 1), np.float32)
    out[:, :-1] = x
    return out


def _noise(h: np.ndarray, target: np.ndarray, bias: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What weighted noise classes add to the gradients in contexts (rows of ``_ones``), and in noise vectors and biases."""
    flat = -_ones(target).T
    flat[-1] *= bias
    pull, down = np.empty((len(h), target.shape[1]), np.float32), np.zeros((len(target), h.shape[1]), np.float32)
    target = target * weight[:, None]
    for i in range(0, len(h), ROWS):
        some = h[i : i + ROWS]
        s = some @ flat
        np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        s += 1
        np.reciprocal(s, out=s)
        np.matmul(s, target, out=pull[i : i + ROWS])
        down += s.T @ some
    return pull, down * weight[:, None]


class LogBilinear:
    """Vectors and biases of a trained model, and what turns counts into it."""

    def __init__(self, context: np.ndarray, target: np.ndarray, bias: np.ndarray, second: np.ndarray | None = None):
        self.context, self.target, self.bias = context, target, bias
        self.second = np.zeros((FAR + 1, context.shape[1]), np.float32) if second is None else second
        self.group = np.zeros(len(bias), np.int64)

    @classmethod
    def train(cls, counts: np.ndarray, width: int = WIDTH, noise: int = NOISE, steps: int = 150, rate: float = 0.05) -> "LogBilinear":
        """Fits pairs counts[context, target] by full-batch noise-contrastive estimation (Adam, fixed seed)."""
        n = len(counts)
        rng = np.random.default_rng(5)
        total = counts.sum()
        p = ((counts.sum(axis=0) + 1) / (total + n)).astype(np.float32)
        seen = (counts / max(total, 1)).astype(np.float32)
        false = noise * seen.sum(axis=1, keepdims=True) * p  # expected noise pairs
        shift = np.log(noise * p)
        value = [rng.normal(0, 0.1, (n, width)).astype(np.float32), rng.normal(0, 0.1, (n, width)).astype(np.float32), np.log(p)]
        first, second = [np.zeros_like(v) for v in value], [np.zeros_like(v) for v in value]
        for t in range(1, steps + 1 if total else 1):
            c, w, b = value
            odds = c @ w.T
            odds += b - shift
            np.clip(odds, -30, 30, out=odds)
            real = np.exp(-odds)
            real += 1
            np.reciprocal(real, out=real)
            error = seen - (seen + false) * real  # gradient of the objective in each score
            for k, g in enumerate((error @ w, error.T @ c, error.sum(axis=0))):
                g = g * np.float32(n)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                value[k] = value[k] + np.float32(rate) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-6)
        return cls(*value)

    def grouped(self, counts: np.ndarray, rounds: int = 20) -> "LogBilinear":
        """Puts classes into ``FAR`` groups of like vectors before a target (k-means, by frequency, fixed seed); the end is one of its own."""
        rng = np.random.default_rng(21)
        weight = np.sqrt(counts[:-1] + 1)
        x = self.context[:-1].astype(np.float64)
        centre = x[rng.choice(len(x), min(FAR, len(x)), replace=False, p=weight / weight.sum())]
        for _ in range(rounds):
            at = ((centre * centre).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)
            total = np.bincount(at, weight, minlength=len(centre))
            full = total > 0
            for k in range(x.shape[1]):
                centre[full, k] = np.bincount(at, weight * x[:, k], minlength=len(centre))[full] / total[full]
        self.group[:-1], self.group[-1] = at, FAR
        return self

    def refined(self, triples: np.ndarray, counts: np.ndarray, noise: int = NOISE, shared: int = 256, batch: int = 8192, rate: float = 0.01, ordered: bool = False) -> "LogBilinear":
        """Fits rows (class two before, class before, target; sorted here unless ``ordered``) by one pass of noise-contrastive estimation with ``shared`` sampled noise classes a batch (Adam, fixed seed)."""
        n = len(self.bias)
        rng = np.random.default_rng(9)
        p = (counts + 1) / (counts.sum() + n)
        shift = np.log(noise * p).astype(np.float32)
        value = [self.second.copy(), self.context.copy(), self.target.copy(), self.bias.copy()]
        first, second = [np.zeros_like(v) for v in value], [np.zeros_like(v) for v in value]
        rows = (triples if ordered else triples[np.lexsort(triples.T)]).take(rng.permutation(len(triples)), axis=0)
        steps = -(-len(rows) // batch)
        for t in range(1, steps + 1):
            far, near, target = rows[(t - 1) * batch : t * batch].T
            far = self.group[far]
            d, c, w, b = value
            false, times = np.unique(rng.choice(n, shared, p=p), return_counts=True)  # equal noise is scored once
            h, true = _ones(d.take(far, axis=0) + c.take(near, axis=0)), w.take(target, axis=0)
            real = 1 / (1 + np.exp(np.clip(shift[target] - b[target] - np.einsum("ij,ij->i", h[:, :-1], true), -30, 30)))
            up = (1 - real).astype(np.float32)  # gradient of the objective in the scores of true targets
            pull, down = _noise(h, w[false], b[false] - shift[false], (-noise / shared * times).astype(np.float32))
            pull += up[:, None] * true
            grads = [np.zeros_like(v) for v in value]
            _add(grads[0], far, pull)
            _add(grads[1], near, pull)
            _add(grads[2], target, up[:, None] * h[:, :-1])
            grads[2][false] += down[:, :-1]
            grads[3] += np.bincount(target, up, minlength=n).astype(np.float32)
            grads[3][false] += down[:, -1]
            for k, g in enumerate(grads):
                g /= len(far)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                slow = np.float32(rate * (1 - 0.9 * (t - 1) / steps))
                value[k] = value[k] + slow * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + np.float32(1e-6))
        d, c, w, b = value
        out = LogBilinear(c, w, b, d)
        out.group = self.group
        return out

    def log10(self, far: np.ndarray | None = None) -> np.ndarray:
        """Normalised log10 probabilities of all targets after all contexts (and after one class two before each, by default none's vector)."""
        s = ((self.context if far is None else self.context + self.second[self.group[far]]) @ self.target.T + self.bias).astype(np.float64)
        s -= s.max(axis=1, keepdims=True)
        return (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / np.log(10)

    def norms(self, pairs: np.ndarray) -> np.ndarray:
        """Logarithms of the summed exponentials of all targets' scores after pairs (the group two before times the number of classes, plus the class before)."""
        n = len(self.bias)
        flat = np.concatenate((self.target.T, self.bias[None]))
        out = np.empty(len(pairs), np.float64)
        for i in range(0, len(pairs), PAIRS):
            some = pairs[i : i + PAIRS]
            s = _ones(self.second[some // n] + self.context[some % n]) @ flat
            most = s.max(axis=1, keepdims=True)
            s -= most
            np.exp(s, out=s)
            out[i : i + PAIRS] = np.log(s.sum(axis=1)) + most[:, 0]
        return out

    def score(self, far: np.ndarray, near: np.ndarray, target: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each target after its two classes; by the ``norms`` of all pairs, otherwise those that occur are normalised once."""
        far = self.group[far]
        place = far * len(self.bias) + near
        if norms is None:
            pairs, place = np.unique(place, return_inverse=True)
            norms = self.norms(pairs)
        out = self.bias[target] - norms[place]
        for i in range(0, len(out), ROWS):
            k = slice(i, i + ROWS)
            out[k] += np.einsum("ij,ij->i", self.second.take(far[k], axis=0) + self.context.take(near[k], axis=0), self.target.take(target[k], axis=0))
        return out / np.log(10)


class Vocabulary:
    """The frequent words and the totals of the suffix classes without them."""

    def __init__(self, top: np.ndarray, counts: np.ndarray, tokens_: np.ndarray, types: np.ndarray, n: int, v: int):
        by = np.argsort(top)
        self.top, self.tokens, self.types, self.n, self.v = top[by], tokens_.copy(), types.copy(), n, v
        np.subtract.at(self.tokens, (top & _LOW).astype(np.int64), counts)
        np.subtract.at(self.types, (top & _LOW).astype(np.int64), 1)

    @classmethod
    def of(cls, row: pa.Table) -> "Vocabulary":
        top, totals = (np.frombuffer(row.column(c)[0].as_py(), np.int64) for c in ("top", "totals"))
        tokens_, types = totals[:SUFFIXES].astype(float), totals[SUFFIXES : 2 * SUFFIXES].astype(float)
        half = len(top) // 2
        return cls(top[:half].view(np.uint64), top[half:].astype(float), tokens_, types, int(totals[:SUFFIXES].sum() + totals[-2]), int(totals[SUFFIXES : 2 * SUFFIXES].sum() + totals[-1]))

    @property
    def end(self) -> int:
        """The class of the end of a text, the last one."""
        return len(self.top) + SUFFIXES

    def classes(self, keys: np.ndarray) -> np.ndarray:
        out = len(self.top) + (keys & _LOW).astype(np.int64)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, keys), len(self.top) - 1)
            hit = self.top[at] == keys
            out[hit] = at[hit]
        return out

    def within(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of words with these counts in their classes."""
        k = np.maximum(classes - len(self.top), 0)
        p = np.log10((counts + SMOOTH) / (self.tokens[k] + SMOOTH * (self.types[k] + 1)))
        return np.where(classes < len(self.top), 0.0, p)


_OFFER = "bucket int, chunk int, keys binary, counts binary"
_SUMS = "kind int, chunk int, bucket int, counts binary, top binary, totals binary"


def _sums(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split(" ")[0] for x in _SUMS.split(", ")])


def _most_frequent(keys: np.ndarray, counts: np.ndarray, top: int) -> bytes:
    """The ``top`` most frequent words (smaller keys first if equal): their keys, then their counts."""
    seen = np.flatnonzero(counts > 0)
    best = seen[np.lexsort((keys[seen], -counts[seen]))][:top]
    return keys[best].tobytes() + counts[best].astype(np.int64).tobytes()


def _merged(group: pa.Table, top: int = TOP) -> pa.Table:
    """One row of frequent words and totals for many, under a 64th of their number."""
    keys, counts = (np.concatenate([np.frombuffer(x, t).reshape(2, -1)[k] for x in group.column("top").to_pylist()]) for k, t in ((0, np.uint64), (1, np.int64)))
    totals = np.sum([np.frombuffer(x, np.int64) for x in group.column("totals").to_pylist()], axis=0)
    return _sums([(1, -1, group.column("bucket")[0].as_py() // 64, None, _most_frequent(keys, counts, top), totals.tobytes())])


def count_words(parts: DataFrame, n: int, text: str, train: str, top: int = TOP) -> DataFrame:
    """Answers of word buckets: counts for every chunk (kind 0); frequent words and totals by suffix class (kind 1)."""

    def offer(chunk: pa.Table) -> pa.Table:
        data, off = utf8(chunk.column(text))
        learn = chunk.column(train).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        found, seen = [], []
        for i, j in blocks(off):
            key, doc = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            some, place = np.unique(key, return_inverse=True)
            found.append(some)
            seen.append(np.bincount(place[learn[i:j][doc]], minlength=len(some)))
        found.append(np.array([_END_KEY]))
        seen.append(np.array([learn.sum()]))
        keys, place = np.unique(np.concatenate(found), return_inverse=True)
        counts = np.bincount(place, np.concatenate(seen), minlength=len(keys)).astype(np.uint32)
        b, at = sides(keys, n)
        cut = list(zip(at[:-1], at[1:], strict=True))
        return pa.table({"bucket": b, "chunk": pa.array(np.full(len(b), chunk.column("__chunk")[0].as_py(), np.int32)), "keys": pa.array([pack_sorted(keys[i:j]) for i, j in cut], pa.binary()), "counts": pa.array([counts[i:j].tobytes() for i, j in cut], pa.binary())})

    def add(bucket: pa.Table) -> pa.Table:
        runs = [unpack_sorted(x, np.uint64) for x in bucket.column("keys").to_pylist()]
        keys, place = np.unique(np.concatenate(runs), return_inverse=True)
        counts = np.bincount(place, np.concatenate([np.frombuffer(x, np.uint32) for x in bucket.column("counts").to_pylist()]), minlength=len(keys)).astype(np.int64)
        ends = np.cumsum([len(r) for r in runs])
        b = bucket.column("bucket")[0].as_py()
        rows = [(0, c, b, counts[place[e - len(r) : e]].tobytes(), None, None) for c, r, e in zip(bucket.column("chunk").to_pylist(), runs, ends.tolist(), strict=True)]
        word = keys != _END_KEY
        side = (keys & _LOW).astype(np.int64)
        totals = np.concatenate((
            np.bincount(side[word], counts[word], minlength=SUFFIXES).astype(np.int64),
            np.bincount(side[word & (counts > 0)], minlength=SUFFIXES),
            [counts[~word].sum(), (counts[~word] > 0).sum()],
        ))
        rows.append((1, -1, b, None, _most_frequent(keys[word], counts[word], top), totals.tobytes()))
        return _sums(rows)

    return parts.groupBy("__chunk").applyInArrow(offer, _OFFER).groupBy("bucket").applyInArrow(add, _SUMS)


def count_pairs(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> np.ndarray:
    """Counts of adjacent classes of all texts; a text starts after, and ends with, the end's class."""
    size = vocabulary.end + 1
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        v, held = shared.value, []

        def merged():
            k = np.concatenate([a for a, _ in held])
            by = np.argsort(k, kind="stable")
            at = np.flatnonzero(np.append(True, k[by][1:] != k[by][:-1]))
            return k[by][at], np.add.reduceat(np.concatenate([b for _, b in held])[by], at)

        for batch in batches:
            data, off = utf8(batch.column(0))
            for i, j in blocks(off):
                key, doc = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                _, before, after, _, _ = sequence(v.classes(key), doc, j - i, v.end)
                held.append(np.unique(before * size + after, return_counts=True))
            if sum(len(a) for a, _ in held) > 4_000_000:  # at most the square of the classes remain
                held[:] = [merged()]
        if held:
            k, n = merged()
            part, at = np.unique(k // (size * GROUP), return_index=True)
            cut = list(zip(at, [*at[1:], len(k)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([(k[i:j] - p * size * GROUP).astype(np.uint32).tobytes() for p, (i, j) in zip(part, cut, strict=True)], pa.binary()), pa.array([n[i:j].astype(np.int64).tobytes() for i, j in cut], pa.binary())], names=["part", "pairs", "n"])

    def add(group: pa.Table) -> pa.Table:
        block = np.zeros(size * GROUP)
        for a, n in zip(group.column("pairs").to_pylist(), group.column("n").to_pylist(), strict=True):
            block[np.frombuffer(a, np.uint32)] += np.frombuffer(n, np.int64)
        return pa.table({"part": group.column("part")[:1], "block": pa.array([block.tobytes()], pa.binary())})

    out = np.zeros(-(-size // GROUP) * GROUP * size)
    parts = docs.select(text).mapInArrow(count, "part int, pairs binary, n binary").groupBy("part").applyInArrow(add, "part int, block binary")
    for r in parts.toLocalIterator():  # blocks, as many as groups of contexts
        out[r.part * size * GROUP : (r.part + 1) * size * GROUP] = np.frombuffer(r.block)
    return out.reshape(-1, size)[:size]


def triples_of(texts: list[bytes], end: int) -> np.ndarray:
    """Rows (class two before, class before, target) of texts as classes, each with its end."""
    target = np.frombuffer(b"".join(texts), np.int32)
    near = np.append(end, target[:-1])[: len(target)]
    far = np.where(near == end, end, np.append([end, end], target[:-2])[: len(target)])
    return np.stack((far, near, target), axis=1).astype(np.int32)


def refine(docs: DataFrame, size: int, vocabulary: Vocabulary, model: LogBilinear, counts: np.ndarray, text: str = "text") -> LogBilinear:
    """The model after one pass over every triple of all texts (``size`` bytes): the mean, by triples, of copies that each trained on a share of the texts.

    A share is in the order of its texts, so results do not depend on partitions.
    """
    shares = max(1, -(-size // MOST))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model, counts))
    shapes = [v.shape for v in (model.second, model.context, model.target, model.bias)]

    def classes(batches):
        v = shared.value[0]
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in blocks(off):
                key, doc = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                _, _, after, row, _ = sequence(v.classes(key), doc, j - i, v.end)
                raw, cut = after.astype(np.int32).tobytes(), np.append(0, np.cumsum(np.bincount(row, minlength=j - i))) * 4
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([raw[p:q] for p, q in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["share", "classes"])

    def train(share: pa.Table) -> pa.Table:
        v, m, seen = shared.value
        rows = triples_of(sorted(share.column("classes").to_pylist()), v.end)
        m = m.refined(rows, seen, ordered=True)
        flat = np.concatenate([x.ravel() for x in (m.second, m.context, m.target, m.bias)]).astype(np.float64) * len(rows)
        release()
        return pa.table({"share": share.column("share")[:1], "n": pa.array([len(rows)], pa.int64()), "model": pa.array([flat.tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(group.column("share")))
        total = np.zeros(sum(int(np.prod(s)) for s in shapes))
        for k in order:
            total += np.frombuffer(group.column("model")[k].as_py())
        return pa.table({"share": pa.array([group.column("share")[0].as_py() // 64], pa.int32()), "n": pa.array([sum(group.column("n").to_pylist())], pa.int64()), "model": pa.array([total.tobytes()], pa.binary())})

    dealt = docs.select(F.pmod(F.xxhash64(F.lit(11), F.col(text)), F.lit(shares)).cast("int").alias("share"), text)
    sums = dealt.mapInArrow(classes, "share int, classes binary").groupBy("share").applyInArrow(train, "share int, n long, model binary")
    sums = sums.groupBy(F.floor(F.col("share") / 64)).applyInArrow(add, "share int, n long, model binary")
    n, total = 0, 0.0
    for r in sums.orderBy("share").toLocalIterator():  # a 64th of the shares
        n, total = n + r.n, total + np.frombuffer(r.model)
    if not n:
        return model
    cut = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    second, context, target, bias = (x.reshape(s).astype(np.float32) for x, s in zip(np.split(total / n, cut), shapes, strict=True))
    out = LogBilinear(context, target, bias, second)
    out.group = model.group
    return out


def all_norms(docs: DataFrame, shared) -> np.ndarray:
    """The norms of every pair of contexts of a broadcast vocabulary and model, dealt by groups; the work follows the square of the classes, not the texts."""
    session = docs.sparkSession

    def norms(batches):
        _, m = shared.value
        n = len(m.bias)
        for batch in batches:
            for g in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([m.norms(g * n + np.arange(n)).tobytes()], pa.binary())], names=["id", "norms"])

    found = session.range(0, FAR + 1, 1, min(FAR + 1, session.sparkContext.defaultParallelism)).mapInArrow(norms, "id long, norms binary")
    return np.concatenate([np.frombuffer(r.norms) for r in sorted(found.collect())])


def sequence(classes: np.ndarray, doc: np.ndarray, n: int, end: int):
    """The two classes before, targets and rows of all tokens, ends included, and which tokens are ends."""
    size = np.bincount(doc, minlength=n)
    ends = np.cumsum(size + 1) - 1
    target = np.full(len(doc) + n, end, np.int64)
    is_end = np.zeros(len(target), bool)
    is_end[ends] = True
    target[~is_end] = classes
    near = np.append(end, target[:-1])[: len(target)]
    far = np.append([end, end], target[:-2])[: len(target)]
    far[ends - size] = end  # a text's first token
    return far, near, target, np.repeat(np.arange(n), size + 1), is_end


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 10) -> DataFrame:
    """Key, fold, token counts, the unigram base and the model's log10 probability of every row.

    The model learns from rows whose key's CRC-32 is not divisible by ``folds``.
    """
    docs = docs.select(key, text, (~held_out(key, folds)).alias("__train"))
    parts, n = chunked(docs, text, key)
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).head()[0] or 0
    more = max(1.0, size / GROWS)
    top = 64 * round(TOP / 64 * more ** (1 / 6))
    merge = lambda group: _merged(group, top)
    sums = kept(count_words(parts, n, text, "__train", top))
    tops = sums.where("kind = 1")
    for _ in range(2):
        tops = tops.groupBy(F.floor(F.col("bucket") / 64)).applyInArrow(merge, _SUMS)
    rows = tops.toArrow()
    if not len(rows):  # no documents
        rows = _sums([(1, -1, 0, None, b"", np.zeros(2 * SUFFIXES + 2, np.int64).tobytes())])
    vocabulary = Vocabulary.of(merge(rows))
    counts = count_pairs(docs.where("__train"), vocabulary, text)
    model = LogBilinear.train(counts).grouped(counts.sum(axis=0))
    model = refine(docs.where("__train"), size, vocabulary, model, counts.sum(axis=0), text)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    every_norm = docs.sparkSession.sparkContext.broadcast(all_norms(docs, shared))
    schema = f"`{key}` {dict(docs.dtypes)[key]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def settle(chunk: pa.Table, answer: pa.Table) -> pa.Table:
        v, m = shared.value
        data, off = utf8(chunk.column(text)) if len(chunk) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        found = [tokens(data[off[i] : off[j]], off[i : j + 1] - off[i]) + (i, j) for i, j in blocks(off)]
        keys = np.unique(np.concatenate([np.unique(k) for k, *_ in found] + [np.array([_END_KEY])]))
        order = np.argsort(np.asarray(answer.column("bucket"))) if len(answer) else []
        blobs = answer.column("counts").to_pylist()
        counts = np.concatenate([np.frombuffer(blobs[k], np.int64) for k in order]) if len(order) else np.zeros(0, np.int64)
        if len(chunk) and len(counts) != len(keys):
            raise RuntimeError("a chunk and its word counts do not fit")
        base = np.log10((counts + SMOOTH) / (v.n + SMOOTH * (v.v + 1)))
        classes = v.classes(keys)
        inside = v.within(classes, counts)
        end = int(np.searchsorted(keys, _END_KEY))
        n_tokens, n_known, bases, asked, inner, rows_of = [], [], [], [], [], []
        for key_, doc, i, j in found:
            place = np.searchsorted(keys, key_)
            far, before, after, row, is_end = sequence(classes[place], doc, j - i, v.end)
            every = np.full(len(after), end)
            every[~is_end] = place
            n_tokens.append(np.bincount(row, minlength=j - i))
            n_known.append(np.bincount(row, counts[every] > 0, minlength=j - i))
            bases.append(np.bincount(row, base[every], minlength=j - i))
            asked.append((far, before, after))
            inner.append(np.where(is_end, 0.0, inside[every]))
            rows_of.append(row + i)
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (n_tokens, n_known, bases)]
        scored = np.zeros(len(chunk))
        if asked:
            found_ = m.score(*(np.concatenate(x) for x in zip(*asked, strict=True)), every_norm.value)
            scored = np.bincount(np.concatenate(rows_of), found_ + np.concatenate(inner), minlength=len(chunk))
        release()
        train = chunk.column("__train").to_numpy(zero_copy_only=False).astype(bool)
        return pa.table(
            [chunk.column(key), pa.array(~train), pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(np.full(len(chunk), v.n, np.int64)), pa.array(flat[2]), pa.array(scored)],
            names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    answers = sums.where("kind = 0").select(F.col("chunk").alias("__chunk"), "bucket", "counts")
    return parts.groupBy("__chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(settle, schema)


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores every document with a model of the training fold."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
