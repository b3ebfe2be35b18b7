"""Each operator against brute force or an exact round trip, and on edge cases."""

import hashlib
import os
import random
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera import llm
from tessera.llm import _blocks, _chunks, _links, bilinear, bpe, chat, mixing, mpeg, quality, repeats, rindex, simhash, toxicity, wide

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module", autouse=True)
def small_chunks():
    """Several chunks even for small tables."""
    old = _chunks.LEAST
    _chunks.LEAST = 2000
    yield
    _chunks.LEAST = old


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty, blank and long texts, repeated rows, ties, null ids."""
    rng = random.Random(7)
    vocab = ["w" + "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = say(40)
    out = [(i, say(rng.randint(1, 120)), "en", f"s{i % 4}", None) for i in range(40)]
    out += [(40 + i, f"{say(10)}\n{passage}  {say(12)}", "en", "s0", 3) for i in range(12)]
    out += [(60 + i, out[3][1], None, "s1", 1) for i in range(6)]
    out += [(70, None, "en", None, None), (71, "", "en", "s2", 0), (72, " \t\n", "en", "s2", 0), (73, say(5000), "de", "s3", 9), (74, "ab" * 3000, "de", "s3", 9), (75, "one", "de", "s3", 9), (76, "one two", "de", "s3", 9)]
    out += [(80, "x y " * 40, "en", "s1", 1), (80, "x y " * 40, "en", "s1", 1), (None, passage, "en", "s1", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_windows(rows, units, size):
    """Places of each row that lie in windows which a smaller id has."""
    first = {}
    for i, t in rows:
        u = units(t)
        for k in range(len(u) - size + 1):
            w = tuple(u[k : k + size]) if isinstance(u, list) else u[k : k + size]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        u, gone = units(t), set()
        for k in range(len(u) - size + 1):
            w = tuple(u[k : k + size]) if isinstance(u, list) else u[k : k + size]
            if i is not None and first[w] < i:
                gone.update(range(k, k + size))
        out.append((i, u, gone))
    return out


def test_bpe_equals_library(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    vocabulary = bpe.public_vocabulary()
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    c = bpe.PairCodec(vocabulary)
    rng = random.Random(1)
    texts = ["", "aaaaaaaa aaa", "a\x1cb\x85 ²½Ⅷ٣ \n\n x's <|endoftext|><|endoftext|>", "\U0002b73a\U0001e6c0՘", "don't we'll '  end  ", "  \t"]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(60)) for _ in range(200)]
    ids = c.encode(texts)
    assert ids == [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)] and [c.decode(x) for x in ids] == texts
    assert c.decode([50256, 0, 188, 188]) == tk.decode([50256, 0, 188, 188], skip_special_tokens=False)
    got = {(r.doc_id, r.text): r.ids for r in bpe.encode(docs, vocabulary).collect()}
    assert got[70, None] == [] and got[75, "one"] == tk.encode("one").ids
    back = bpe.decode(bpe.encode(docs, vocabulary), vocabulary, into="back")
    assert back.where("coalesce(text, '') <> back").count() == 0 and set(docs.columns) < set(back.columns)
    assert bpe.digests(empty, vocabulary).count() == 0 and bpe.tokenize(docs, vocabulary).where("not exact").count() == 0


def test_lm_is_normalised_and_beats_its_base(spark, docs, empty):
    rng = np.random.RandomState(0)
    counts = rng.poisson(3, (50, 50)).astype(float)
    counts[:25, :25] += 40
    table = bilinear.LogBilinear.train(counts, width=4).log10()
    assert np.allclose((10**table).sum(axis=1), 1) and (counts * table).sum() > (counts * np.log10(counts.sum(0) / counts.sum())).sum()
    got = {r.doc_id: r for r in bilinear.score(docs.where("doc_id is not null and doc_id <> 80")).collect()}
    texts = {r.doc_id: words((r.text or "").lower()) + [None] for r in docs.where("doc_id is not null and doc_id <> 80").collect()}
    train = [w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in ws]
    c = {w: train.count(w) for w in set(train)}
    for i, ws in texts.items():
        base = sum(np.log10((c.get(w, 0) + 0.1) / (len(train) + 0.1 * (len(c) + 1))) for w in ws)
        r = got[i]
        assert r.base_score == pytest.approx(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in c for w in ws), len(train))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and r.score < 0
    assert bilinear.score(empty).count() == 0


def test_lm_of_two_places():
    rng = np.random.default_rng(3)
    far, near = rng.integers(0, 20, (2, 60000))
    target = np.where(rng.random(60000) < 0.8, (far + 1) % 20, rng.integers(0, 20, 60000))  # the class two before tells
    counts = np.zeros((20, 20))
    np.add.at(counts, (near, target), 1)
    one = bilinear.LogBilinear.train(counts, width=8)
    one.group = np.arange(20)
    two = one.refined(np.stack((far, near, target), axis=1).astype(np.int32), counts.sum(axis=0), batch=512, rate=0.05)
    a, b = one.score(far, near, target), two.score(far, near, target)
    assert b.mean() > a.mean() + 0.3
    every = two.score(np.repeat(4, 20), np.repeat(7, 20), np.arange(20))
    assert (10**every).sum() == pytest.approx(1, abs=1e-5) and np.allclose(every, two.log10(np.full(20, 4))[7], atol=1e-5)
    seq = bilinear.sequence(np.array([3, 4, 5, 6]), np.array([0, 0, 2, 2]), 3, 9)
    assert [x.tolist() for x in seq[:4]] == [[9, 9, 3, 9, 9, 9, 5], [9, 3, 4, 9, 9, 5, 6], [3, 4, 9, 9, 5, 6, 9], [0, 0, 0, 1, 2, 2, 2]]


def plainly_refined(m, triples, counts, noise=10, shared=256, batch=8192, rate=0.01):
    """What ``refined`` does, in float64 with every sampled noise class by itself."""
    n, rng = len(m.bias), np.random.default_rng(9)
    p = (counts + 1) / (counts.sum() + n)
    shift = np.log(noise * p)
    value = [x.astype(float) for x in (m.second, m.context, m.target, m.bias)]
    first, second = [[np.zeros_like(x) for x in value] for _ in range(2)]
    rows = triples[np.lexsort(triples.T)][rng.permutation(len(triples))]
    steps = -(-len(rows) // batch)
    for t in range(1, steps + 1):
        far, near, target = rows[(t - 1) * batch : t * batch].T
        d, c, w, b = value
        false = rng.choice(n, shared, p=p)
        h = d[m.group[far]] + c[near]
        up = 1 - 1 / (1 + np.exp(-((h * w[target]).sum(axis=1) + b[target] - shift[target])))
        down = -noise / shared / (1 + np.exp(-(h @ w[false].T + b[false] - shift[false])))
        pull = up[:, None] * w[target] + down @ w[false]
        grads = [np.zeros_like(x) for x in value]
        for g, at, x in ((0, m.group[far], pull), (1, near, pull), (2, target, up[:, None] * h), (2, false, down.T @ h), (3, target, up), (3, false, down.sum(axis=0))):
            np.add.at(grads[g], at, x)
        for k, g in enumerate(grads):
            first[k] += 0.1 * (g / len(far) - first[k])
            second[k] += 0.01 * ((g / len(far)) ** 2 - second[k])
            value[k] = value[k] + rate * (1 - 0.9 * (t - 1) / steps) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-6)
    return value


def test_lm_trains_in_small_blocks():
    rng = np.random.default_rng(8)
    triples = np.minimum(rng.geometric(0.05, (20000, 3)) - 1, 299).astype(np.int32)
    counts = np.zeros((300, 300))
    np.add.at(counts, (triples[:, 1], triples[:, 2]), 1)
    m = bilinear.LogBilinear.train(counts, steps=5).grouped(counts.sum(axis=0))
    tracemalloc.start()
    got = m.refined(triples, counts.sum(axis=0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8192 * 256 * 4  # less than the scores of a batch with all its noise: they stay in the cache
    for x, y in zip((got.second, got.context, got.target, got.bias), plainly_refined(m, triples, counts.sum(axis=0)), strict=True):
        assert x.dtype == np.float32 and np.allclose(x, y, atol=1e-3)


class Counted(bilinear.LogBilinear):
    """A model that tells how many contexts it normalised."""

    def norms(self, pairs):
        self.normalised = getattr(self, "normalised", 0) + len(pairs)
        return super().norms(pairs)


def test_lm_normalises_pairs_of_contexts_once(spark, docs):
    rng = np.random.default_rng(8)
    counts = rng.poisson(2, (300, 300)).astype(float)
    m = Counted.train(counts, steps=20).grouped(counts.sum(axis=0))
    m.second = rng.normal(size=m.second.shape).astype(np.float32)
    norms = bilinear.all_norms(docs, spark.sparkContext.broadcast((None, m)))
    assert len(norms) == (bilinear.FAR + 1) * 300
    far, near, target = rng.integers(0, 300, (3, 5000))
    chunks = [m.score(far[i : i + 100], near[i : i + 100], target[i : i + 100], norms) for i in range(0, 5000, 100)]
    assert not hasattr(m, "normalised")  # no chunk of texts repeats that work
    s = np.array([(m.second[m.group[f]].astype(float) + m.context[c]) @ m.target.T + m.bias for f, c in zip(far, near, strict=True)])
    want = (s[np.arange(5000), target] - np.log(np.exp(s).sum(axis=1))) / np.log(10)
    assert np.allclose(np.concatenate(chunks), want, atol=1e-5) and np.allclose(m.score(far, near, target), want, atol=1e-5)
    assert m.normalised == len(set(zip(m.group[far].tolist(), near.tolist(), strict=True)))


class Told(bilinear.LogBilinear):
    """A model whose bias tells the triples it saw."""

    def refined(self, triples, counts, ordered=False):
        return bilinear.LogBilinear(self.context, self.target, np.bincount(triples[:, 2], minlength=len(self.bias)) / len(triples), self.second)


def test_lm_trains_on_every_triple(spark, docs, monkeypatch):
    rows = docs.where("doc_id is not null")
    v = bilinear.Vocabulary(np.zeros(0, np.uint64), np.zeros(0), np.zeros(bilinear.SUFFIXES), np.zeros(bilinear.SUFFIXES), 1, 1)
    n = sum(len(words((r.text or "").lower())) + 1 for r in rows.collect())
    counts = bilinear.count_pairs(rows, v)
    model = Told.train(counts, steps=2).grouped(counts.sum(axis=0))
    assert counts.sum() == n

    monkeypatch.setattr(bilinear, "MOST", 2000)
    for parts in (1, 5):
        out = bilinear.refine(rows.repartition(parts), 20000, v, model, counts.sum(axis=0))  # ten shares
        assert np.allclose(out.bias * n, counts.sum(axis=0), atol=1e-2)
    far, near, target = bilinear.triples_of([np.array([3, 4, 9], np.int32).tobytes(), np.array([9], np.int32).tobytes(), np.array([5, 6, 9], np.int32).tobytes()], 9).T
    want = bilinear.sequence(np.array([3, 4, 5, 6]), np.array([0, 0, 2, 2]), 3, 9)
    assert [x.tolist() for x in (far, near, target)] == [x.tolist() for x in want[:3]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_lm_beats_its_base_on_held_out_texts(spark):
    got = bilinear.op2_lm_score(spark, SF.replace("0.001", "0.01")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count(F.lit(1))).head()
    assert got[2] > 50 and got[0] > 0.95 * got[1]


def test_lm_probabilities_add_up():
    top = np.array([1 << 12, 2 << 12], np.uint64)
    tokens_, types = np.zeros(bilinear.SUFFIXES), np.zeros(bilinear.SUFFIXES)
    tokens_[0], types[0], tokens_[5], types[5] = 20, 4, 7, 2  # class 0 holds both frequent words and two others
    v = bilinear.Vocabulary(top, np.array([9.0, 6.0]), tokens_, types, 27, 6)
    inside = [10 ** v.within(np.array([2]), np.array([n]))[0] for n in (3, 2, 0)]
    assert sum(inside) == pytest.approx(1)


def test_long_repeats_equal_brute_force(docs, rows, empty):
    want = {}
    for i, u, gone in brute_windows([(r[0], r[1]) for r in rows], lambda t: (t or "").encode(), 50):
        kept = bytes(b for k, b in enumerate(u) if k not in gone)
        spans = sum(k in gone and k - 1 not in gone for k in range(len(u)))
        want[i, u] = (len(u), len(gone), spans, kept)
    got = rindex.find_long_repeats(docs.withColumn("kept", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert want[r.doc_id, (r.text or "").encode()] == (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
    assert rindex.find_long_repeats(empty).count() == 0


def test_run_length_index():
    rng = random.Random(3)
    pack = lambda ts: (np.frombuffer(b"".join(ts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in ts]))))
    for trial in range(20):
        texts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6))] * (1 + trial % 2)
        index = rindex.RunLengthIndex(*pack(texts))
        query = [bytes(rng.choice(b"abz\x00") for _ in range(15)), texts[0]]
        data, off = pack(query)
        lengths, row = index.matching_statistics(data, off)
        for q, start in zip(query, off, strict=False):
            for j in range(len(q)):
                best = max(next((n for n in range(min(len(q) - j, len(t) - k) + 1) if n == min(len(q) - j, len(t) - k) or q[j + n] != t[k + n])) for t in texts for k in range(len(t)))
                assert lengths[start + j] == best
        assert index.runs <= len(index.symbol)


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a<|end|>\n&lt;<b"), (1, 1, "assistant", "x & <|turn|>y"), (1, 2, None, None), (1, 3, "assistant", ""), (2, 5, "assistant", "é" * 5000), (2, 5, "assistant", "é" * 5000), (None, 1, "us\ner", "q")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{_links.shared_folder(spark)}/chat/conversations.parquet")
    folder = f"{_links.shared_folder(spark)}/chat"
    got = {r.conv_id: r for r in chat.op4_chat_format(spark, folder).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in (1, 2, None):
        mine = [t for t in turns if t[0] == conv]
        assert got[conv].n_turns == len(mine) and got[conv].turns_sha256 == sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine))
        said = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), sha(said))
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len("</s>[INST] ok [/INST]")


def test_reply_trees(spark):
    m = "conv long, name long, parent long, role string, text string, score double"
    rows = [(1, 1, None, "u", "root", 0.0), (1, 2, 1, "a", "low", 1.0), (1, 3, 1, "a", "high", 5.0), (1, 4, 3, "u", "deep", 1.0), (1, 5, 6, "x", "cycle", 9.0), (1, 6, 5, "x", "cycle", 9.0), (2, 1, 99, "u", "orphan", None)]
    got = [tuple(r) for r in chat.branches(spark.createDataFrame(rows, m), 2).orderBy("conv", "rank", "depth").collect()]
    assert got == [(1, 1, 0, "u", "root"), (1, 1, 1, "a", "high"), (1, 1, 2, "u", "deep"), (1, 2, 0, "u", "root"), (1, 2, 1, "a", "low"), (2, 1, 0, "u", "orphan")]
    chain = [(1, i, i - 1 if i else None, "u", str(i), 0.0) for i in range(100)]
    assert [r.text for r in chat.branches(spark.createDataFrame(chain, m)).orderBy("depth").collect()] == [str(i) for i in range(100)]
    assert chat.format_branches(chat.branches(spark.createDataFrame([], m))).count() == 0


def test_word_repeats_equal_brute_force(docs, rows, empty):
    want = {(i, tuple(u)): (len(u), len(gone), b" ".join(w for k, w in enumerate(u) if k not in gone)) for i, u, gone in brute_windows([(r[0], r[1]) for r in rows], words, 13)}
    got = repeats.find_repeats(docs.withColumn("n_words", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r in got:
        n, lost, kept = want[r.doc_id, tuple(words(r.text))]
        assert (r.n_words, r.n_removed) == (n, lost) and (r.kept == r.text if not lost else r.kept.encode() == kept)
    assert repeats.find_repeats(empty).count() == 0


def test_windows_that_collide_are_told_apart(spark, tmp_path):
    a, swap = "a", str.maketrans("ab", "ba")
    for _ in range(12):  # two words that any polynomial hash modulo 2**64 takes for equal
        a += a.translate(swap)
    texts = [" ".join([*(f"w{k}" for k in range(12)), w]) for w in (a, a.translate(swap), a)]
    data, off = _blocks.utf8(pa.array(texts))
    starts, ends, doc = _blocks.words(data, off)
    assert len(set(_blocks.windows(_blocks.span_hash(_blocks.prefix(data), starts, ends), doc, 13)[0].tolist())) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeats.find_repeats(docs).collect()} == {0: 0, 1: 0, 2: 13}
    log = repeats.RunLog(spark, str(tmp_path / "log"), buckets=4)
    log.add(docs.where("doc_id = 0"))
    log.add(docs.where("doc_id = 5"))
    log.compact()
    assert {r.doc_id: r.n_removed for r in log.add(docs.where("doc_id > 0")).collect()} == {1: 0, 2: 13}


def test_run_log_adds_and_compacts(spark, tmp_path):
    say = lambda s: " ".join(f"{s}{i}" for i in range(20))
    frame = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    log = repeats.RunLog(spark, str(tmp_path / "log"), buckets=4)
    assert log.add(frame((5, say("a")), (6, say("b")))).agg(F.sum("n_removed")).head()[0] == 0
    got = {r.doc_id: r.n_removed for r in log.add(frame((1, say("a")), (2, "new " + say("c")))).collect()}
    assert got == {1: 20, 2: 0}  # history is earlier, whatever its ids
    log.compact()
    assert len(log.names()) == 1
    got = {r.doc_id: r.n_removed for r in log.add(frame((9, "x " + say("c")), (10, "fresh text"))).collect()}
    assert got == {9: 20, 10: 0}


def test_quality_rules(docs, rows, empty):
    got = quality.ledger(docs, keys=("doc_id", "text")).collect()
    for r in got:
        t = r.text or ""
        ws = words(t)
        grams = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        again = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 500 else None
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(ws), sum(len(w.decode()) for w in ws), len(lines) - len(set(lines)))
        assert again is None or r.n_repeat_words == len(again)
        assert (r.fail_bits & quality.mask("base") != 0) == (len(ws) < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    ab = {r.rule: r for r in quality.ablations(quality.ledger(docs)).collect()}
    assert ab["few_words"].failed == sum(r.n_words < 50 for r in got) and ab["few_words"].kept_without >= sum(r.fail_bits == 0 for r in got)
    assert quality.ledger(empty).count() == 0


def test_mix_reaches_targets(docs, rows, empty):
    got = mixing.mix(docs.withColumn("size", F.lit("clash")), mixing.rotating).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r.size == len(words(r.text)) and r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert sum(x[0].target for x in by.values()) == pytest.approx(total)
    assert mixing.in_order(by) == ["s0", "s1", "s2", "s3", None]
    for s, x in by.items():
        assert x[0].source_size == sum(r.size for r in x) and abs(sum(r.taken for r in x) - x[0].target) <= max([r.size for r in x])
    again = mixing.mix(docs.repartition(5), mixing.rotating).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and mixing.mix(empty, mixing.rotating).count() == 0


def test_flow_is_cheapest():
    t = mixing.targets({"a": 10.0, "b": 1000.0}, {"a": 1, "b": 1}, 1010.0, 3)
    assert t == {"a": 30.0, "b": 980.0}
    flow = mixing.route({("a",): 10.0, ("a", "b"): 10.0, ("b",): 10.0}, {"a": 12.0, "b": 18.0}, 3)
    assert sum(f.get("a", 0) for f in flow.values()) == 12 and sum(f.get("b", 0) for f in flow.values()) == 18
    assert all(sum(f.values()) <= 10 + 1e-9 for f in flow.values())  # no repetition where none is needed


def test_mix_of_many_sources(spark):
    df = spark.range(120_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), (F.col("id") % 50_000).cast("string").alias("source"))
    got = mixing.mix(df, mixing.rotating, carry=("doc_id", "source"))
    off = got.groupBy("source").agg((F.sum("taken") - F.first("target")).alias("off"), F.max("size").alias("most"))
    assert off.count() == 50_000 and off.where("abs(off) > most").count() == 0


def test_mix_cuts_ranges_again(spark, docs, monkeypatch):
    plain = {(r.doc_id, r.text): r.taken for r in mixing.mix(docs, mixing.rotating).collect()}
    monkeypatch.setattr(mixing, "RANGE", 1)
    assert plain == {(r.doc_id, r.text): r.taken for r in mixing.mix(docs, mixing.rotating).collect()}


def test_mix_equals_brute_force(spark, tmp_path, docs, rows):
    """Documents of the plan: whole repetitions, then those first in the seeded order, then the best one more."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.op7_mixing(spark, str(tmp_path)).collect())
    seeded = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((seeded[r[0], r[1]], len(words(r[1])), r[0]))
    names = mixing.in_order(by)
    size = {s: sum(n for _, n, _ in by[s]) for s in by}
    quota = mixing.targets(size, mixing.rotating(names), sum(size.values()), 3)
    want = []
    for s in names:
        whole = min(3, int(quota[s] // size[s])) if size[s] else 0
        rest, once = quota[s] - whole * size[s], set()
        at = {}
        for h, n, _ in by[s]:
            at[h] = at.get(h, 0) + n
        left = rest
        if whole < 3 and rest > 0:
            order = sorted(at)
            while order and at[order[0]] <= left:
                left -= at[order[0]]
                once.add(order.pop(0))
            best = min(((abs(at[h] - left), h) for h in order if at[h]), default=None)
            if best and best[0] < left:
                once.add(best[1])
        want += [(str(i), n, size[s], round(quota[s], 6), n * (whole + (h in once))) for h, n, i in by[s]]
    assert got == sorted(want)


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b"]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix(df, lambda s: {x: 1 for x in s}).collect()
    assert sum(r.taken for r in got) == pytest.approx(900, abs=30)


def test_mpeg_round_trip(docs, empty):
    for n in (0, 1, 64, 1417, 1418, 9000):
        p = mpeg.padded(random.Random(n).randbytes(n))
        m = mpeg.build(p)
        a = mpeg.parse(m)
        assert mpeg.payload(m, a) == p and a.vbr["frames"] == len(a.offsets) and a.crc_ok == len(a.offsets) + 1 and a.crc_bad == a.junk == 0
        assert a.duration == len(a.offsets) * mpeg.Fraction(1152, 32000) and all(m[o : o + 2] == b"\xff\xfa" for o in a.offsets)
        broken = m[: a.offsets[0]] + b"\xff\xfa\x00 junk \xff" * 2 + m[a.offsets[0] :] + b"TAG" + b"t" * 125
        b = mpeg.parse(broken)
        assert len(b.offsets) == len(a.offsets) and b.junk == 20 and b.tags["payload_bytes"] == str(len(p))
        bad = bytearray(m)
        bad[a.offsets[-1] + 9] ^= 4
        assert mpeg.parse(bytes(bad)).crc_bad == 1
    assert mpeg.parse(None).duration == 0 and mpeg.parse(b"\xff" * 50).offsets == [] and mpeg.parse(m[:-5]).junk > 0
    rows = mpeg.probe(mpeg.store(docs.withColumn("samples", F.lit("clash")))).collect()
    assert len(rows) == docs.count() and all(r.crc_bad == 0 and r.n_frames == r.vbr_frames for r in rows)
    assert mpeg.probe(mpeg.store(empty)).count() == 0


def test_mpeg_keeps_text_where_a_tag_may_stand(spark):
    texts = ["x" * k + "TAG" + "y" * (n - k - 3) for n in (65, 100, 128, 1400, 1417, 1600, 3000) for k in range(n - 2)]
    cut = 0
    for t in texts:
        p = mpeg.padded(t.encode())
        m = mpeg.build(p)
        a = mpeg.parse(m)
        assert mpeg.payload(m, a) == p and a.vbr["frames"] == len(a.offsets) and a.junk == 0
        cut += len(m) > m.rfind(b"\xff\xfa") + a.headers[-1].size
    assert cut >= 3
    with pytest.raises(ValueError):
        mpeg.payload(m[:-5], mpeg.parse(m[:-5]))
    r = mpeg.probe(mpeg.store(spark.createDataFrame([("x" * 29 + "TAG" + "y" * 90,)], "text string"))).head()
    assert r.n_frames == r.vbr_frames == 1 and r.junk_bytes == 0


def test_toxicity_restores_and_learns(spark, empty):
    rng = random.Random(5)
    vocab = ["the", "and", "with", "there", "other", "this", "over", "then", "that", "into"]
    tox = ["idiot", "stupid", "moron"]
    say = lambda *more: " ".join(rng.sample([rng.choice(vocab) for _ in range(25)] + list(more), 25 + len(more)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, say(*([rng.choice(tox)] if bad else []))))
        labels.append((i, int(bad)))
    hidden = ["1d10t", "i.d.i.o.t", "i d i o t", "IDIOOOOT!", "$tupid", "m0r0n", "stu pid", "id iot", "s tupid", "stuupid", "iddiot", "mo ro n"]
    rows += [(1000 + k, say() + f" {h} " + say()) for k, h in enumerate(hidden)] + [(2000, None), (2001, ""), (2002, "1 2 3 a a a a"), (None, say()), (3, "a second text of one id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    got = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, lab).collect()}
    assert len(got) == len(rows)
    assert all((got[i, t] >= 0.5) == (i % 4 == 0) for i, t in rows[:400])
    assert [got[r] >= 0.5 for r in rows[400 : 400 + len(hidden)]] == [True] * len(hidden)
    assert all(0 <= x < 0.5 for (i, t), x in got.items() if i is None or i >= 2000 or t == "a second text of one id")
    for none in (lab.where("false"), lab.where("toxic = 0")):
        assert toxicity.score(docs, none).where("score >= 0.5").count() == 0
    assert toxicity.score(empty, lab).count() == 0


def test_toxicity_counts_copies_once_and_grades_evidence(spark):
    rng = random.Random(9)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su") for b in ("ra", "ton", "vel", "dis", "mon")]
    say = lambda *more: " ".join([rng.choice(vocab) for _ in range(30)] + list(more))
    copied = say("vexor")
    rows = [(say("vexor"), 1) for _ in range(60)] + [(copied, 0)] * 1000  # one clean text, copied
    rows += [(t, 1) for t in [say("quibber") for _ in range(60)] for _ in range(20)] + [(say("quibber"), 0) for _ in range(40)]  # 60 texts, and 40 clean ones
    rows += [(say(), 0) for _ in range(800)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(rows)], "doc_id long, text string, toxic int").repartition(3)
    new = spark.createDataFrame([(10**6, say("vexor")), (10**6 + 1, say("quibber")), (10**6 + 2, say())], "doc_id long, text string")
    got = {r.doc_id - 10**6: r.score for r in toxicity.score(docs.drop("toxic").union(new), docs.select("doc_id", "toxic")).where("doc_id >= 1000000").collect()}
    assert got[0] > 0.5 and got[2] + 0.1 < got[1] < got[0] and got[2] < 0.5


def test_toxicity_does_not_depend_on_partitions(spark):
    d = f"{SF.replace('0.001', '0.01')}"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = []
    for n in (4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append({r.doc_id: round(r.score, 9) for r in toxicity.score(docs.repartition(n // 2), labels).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert out[0] == out[1]


def test_curve_through_counts():
    x = np.array([0.0, 1, 2, 4])
    a, b = toxicity.curve(x, np.array([10.0, 30, 60, 95]), np.full(4, 100.0))
    p = 1 / (1 + np.exp(-(a + b * x)))
    assert np.abs(p - [0.1, 0.3, 0.6, 0.95]).max() < 0.06 and toxicity.curve(x, np.array([40.0, 20, 10, 1]), np.full(4, 100.0))[1] == 0


def brute_fingerprint(t):
    ws = [w.decode() for w in (t or "").encode().lower().split()]
    shingles = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_equals_brute_force(spark, docs, rows, empty):
    got = {(r.doc_id, r.fp & (1 << 64) - 1): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    group = list(range(len(fps)))
    for _ in fps:
        for a, (_, p) in enumerate(fps):
            for b, (_, q) in enumerate(fps):
                if (p ^ q).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    for k, (i, f) in enumerate(fps):
        assert got[i, f] == min((fps[j][0] for j in range(len(fps)) if group[j] == group[k] and fps[j][0] is not None), default=None)
    assert simhash.near_duplicates(empty).count() == 0
    stay = [(r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()]
    assert len(stay) == len(set(stay)) == len({group[k] for k in range(len(fps))})


@pytest.mark.parametrize("n_blocks", [1, 2, 4])
def test_vantage_forest_finds_all_links(spark, n_blocks):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = np.concatenate([base[:40] ^ np.uint64(1 << int(k)) ^ np.uint64(1 << int(j)) for k, j in rng.integers(0, 64, (4, 2))])
    fp = np.unique(np.concatenate((base, near)))
    df = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in _links.components(simhash.links(df, n_blocks=n_blocks, shard=16)).collect()}
    label = {int(v): int(v) for v in fp}
    for _ in range(6):
        for a in fp:
            for b in fp[np.bitwise_count(fp ^ a) <= 3]:
                label[int(a)] = label[int(b)] = min(label[int(a)], label[int(b)])
    groups = lambda d: sorted(sorted(k for k in d if d[k] == r) for r in set(d.values()))
    mine = {int(np.int64(v).view(np.uint64)) if v < 0 else int(v): r for v, r in ((int(x), roots.get(int(x), int(x))) for x in fp.view(np.int64))}
    assert groups(mine) == groups(label)


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in _links.components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def shingles(t, size=5):
    ws = (t or "").encode().lower().split()
    return {tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} if ws else set()


def alike(a, b, least=0.8):
    return len(a & b) >= least * len(a | b)


def grouped(items, linked):
    """The number of the first item of each item's class."""
    group = list(range(len(items)))
    while True:
        old = list(group)
        for a in range(len(items)):
            for b in range(a):
                if group[a] != group[b] and linked(items[a], items[b]):
                    group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
        if group == old:
            return group


def test_one_of_each_keeps_different_texts(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine ten"
    for pick in (simhash.one_of_each, wide.one_of_similar):
        for rows, want in (
            ([(1, a), (5, b), (5, a)], {(1, a), (5, b)}),
            ([(5, a), (5, b)], {(5, a), (5, b)}),
            ([(5, a), (5, a), (None, a), (None, b), (None, b), (None, None)], {(5, a), (None, b), (None, None)}),
            ([(7, None), (6, ""), (8, " \n")], {(6, "")}),
        ):
            got = [(r.doc_id, r.text) for r in pick(spark.createDataFrame(rows, "doc_id long, text string").withColumn("least", F.lit(1))).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_similar_documents_equal_brute_force(spark, empty):
    rng = random.Random(21)
    say = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4) for _ in range(n)]
    texts = [" ".join(say(n)) for n in (1, 2, 4, 4, 5, 6, 8, 20)] + ["One  TWO\tthree", "one two three", "one two four"]
    for n in (30, 120, 300, 300, 600, 600, 900):
        base = say(n)
        for changes in (0, 1, 1, n // 70, n // 60, n // 45, n // 30, n // 15):
            near = list(base)
            for k in rng.sample(range(n), changes):
                near[k] = "new" + rng.choice("abcdef")
            texts.append(" ".join(near))
    sets = [shingles(t) for t in texts]
    want = grouped(sets, alike)
    nodes, roots = wide.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shard=16)
    root = {r.node: r.root for r in roots.collect()}
    got = {r.least.k: root.get(r.node, r.node) for r in nodes.collect()}
    of = [got.get(k, got.get(want[k])) for k in range(len(texts))]  # equal words are one node
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if alike(sets[a], sets[b])]
    assert sum(of[a] == of[b] for a, b in pairs) >= 0.95 * len(pairs) and len(pairs) > 60
    assert all(want[a] == want[b] for a in range(len(texts)) for b in range(a) if of[a] == of[b])
    assert wide.one_of_similar(empty).count() == 0


def test_wide_estimates_hold():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.8, 0.95):
        texts = []
        for _ in range(60):
            common = rng.integers(0, 10**6, 400)
            more = round(400 * (1 - share) / share / 2)
            texts += [" ".join(map(str, [*common, *rng.integers(0, 10**6, more)])) for _ in range(2)]
        data, off = _blocks.utf8(pa.array(texts))
        _, n, h, bits = wide.sketch_block(data, off, 1, 14)
        cut = np.cumsum(n)
        sets = [set(h[a:b].tolist()) for a, b in zip(cut - n, cut, strict=True)]
        true = np.array([len(x & y) / len(x | y) for x, y in zip(sets[::2], sets[1::2], strict=True)])
        low, high = wide.estimates(bits[::2], bits[1::2], n[::2].astype(float), n[1::2].astype(float))
        assert ((low <= true) & (true <= high)).all()
        hit = [any(wide.block_values(bits[[a]], 16, t) == wide.block_values(bits[[a + 1]], 16, t) for t in range(53)) for a in range(0, 120, 2)]
        assert share < 0.8 or np.mean(hit) >= 0.9
    assert wide.layout(1000) == (16, 53) and wide.layout(10**9)[0] == 24


def test_forest_is_a_least_spanning_one():
    rng = np.random.default_rng(8)
    for g in (2, 9, 64, 65, 200):
        rows = np.zeros(g, wide._ROW)
        rows["id"], rows["n"] = np.arange(g), 100
        rows["bits"] = np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, g).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, g).astype(np.uint64))
        rows["bits"][g // 2 :] ^= np.uint64(2**64 - 1)
        a, b = wide.forest(rows, 6, 0.8)
        assert len(a) == g - 2 + (g == 2) * 0 and all((x < g // 2) == (y < g // 2) for x, y in zip(a, b, strict=True))


def write_tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_equals_its_parts(spark, rows, tmp_path):
    import corpus_pipeline as cp

    bad = [(1000 + k, "such a vexorous word " + " ".join(f"t{k}x{j}" for j in range(20)), "en", "s1", 1) for k in range(40)]
    good = [*rows, (90, "one two", "en", "s1", 1), (90, "other words of one id", "en", "s1", 1), *bad]
    write_tables(spark, tmp_path, good, [(i, 1, 0) for i in range(30)] + [(None, 1, None)] + [(r[0], 0, 1) for r in bad])
    got = cp.run(spark, str(tmp_path)).collect()
    assert not any(r.doc_id is not None and r.doc_id >= 1000 for r in got)
    items = sorted({(r[0], r[1]) for r in rows} | {(90, "one two"), (90, "other words of one id")}, key=lambda x: (x[0] is None, x[0] or 0))
    group = grouped([shingles(t) for _, t in items], alike)
    kept = [items[k] for k in sorted(set(group))]
    c = bpe.PairCodec(bpe.public_vocabulary())
    want = set()
    for i, u, gone in brute_windows(kept, words, 13):
        if not u or len(gone) < len(u):
            texts = [next(t for j, t in kept if j == i and words(t) == u) or "" if not gone else b" ".join(w for k, w in enumerate(u) if k not in gone).decode()]
            want.add((i, tuple(c.encode(texts)[0])))
    assert got and all(r.exact and (r.doc_id, tuple(r.ids)) in want for r in got)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "repeats", "mixing", "bpe"]
    assert max(sum(r.doc_id == i and tuple(r.ids) == x for r in got) for i, x in want) <= 3


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as cp

    write_tables(spark, tmp_path, [], [])
    assert cp.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a = llm.queries()[name](spark, SF).toPandas()
    b = con.sql(llm.oracle_sql()[name]).df()[a.columns]
    a, b = (d.sort_values(list(d.columns)).reset_index(drop=True) for d in (a, b))
    assert len(a) == len(b) and all((a[c] == b[c]).all() for c in a)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_toxicity_on_held_out_labels(spark):
    d = SF.replace("0.001", "0.1")
    got = toxicity.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] > 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) < 0.01 * n[0, 0]
