"""The registered queries against brute force or the library, over whole tables, and on texts longer than a block."""

import hashlib
import os
import random
import zlib

import pytest

from tessera.llm import _blocks, bpe, mpeg, quality, repeats, rindex, simhash

from .test_llm import SF, brute_fingerprint, brute_windows, grouped, words

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(2)
    base = [f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}é" for _ in range(40_000)]
    a, b = " ".join(base * 3), " ".join(["new", *base[1000:30_000], "end"])
    assert len(a.encode()) > 1.5 * _blocks.BLOCK
    return [(1, "short text before"), (2, a), (3, b), (4, "short text after"), (5, " ".join(base[:200]))]


def test_op1(spark, texts):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for i, t in texts:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(tk.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1_bpe(spark, SF).collect()} == want


def test_op3(spark, texts):
    want = {}
    for i, u, gone in brute_windows(texts, lambda t: (t or "").encode(), 50):
        want[i] = (len(u), len(gone), sum(k in gone and k - 1 not in gone for k in range(len(u))), sha(bytes(x for k, x in enumerate(u) if k not in gone)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rindex.op3_suffix_array_dedup(spark, SF).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_op8(spark, texts):
    want = {}
    for i, t in texts:
        p = mpeg.padded((t or "").encode())
        want[i] = (len((t or "").encode()), len(p), sha(p), zlib.crc32(p[-64:]))
    rows = mpeg.op8_mpeg_audio(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
    by = {}
    for r in rows:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by.values())


def test_op10(spark, texts):
    texts = sorted(texts)
    fps = [brute_fingerprint(t) for _, t in texts]
    group = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    want = {i: (f"{f:016x}", texts[g][0]) for (i, _), f, g in zip(texts, fps, group, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, SF).collect()} == want


def test_texts_longer_than_a_block(spark, long_texts):
    docs = spark.createDataFrame(long_texts, "doc_id long, text string")
    want = {i: (len(u), len(gone)) for i, u, gone in brute_windows(long_texts, words, 13)}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in repeats.find_repeats(docs).collect()} == want and want[3][1] > 20_000
    got = {r.doc_id: (r.n_bytes, r.n_removed, sha(bytes(r.kept))) for r in rindex.find_long_repeats(docs).collect()}
    assert got == {i: (len(u), len(gone), sha(bytes(x for k, x in enumerate(u) if k not in gone))) for i, u, gone in brute_windows(long_texts, lambda t: t.encode(), 50)}
    assert {r.doc_id: r.n_words for r in quality.ledger(docs).collect()} == {i: len(words(t)) for i, t in long_texts}
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()} == {i: brute_fingerprint(t) for i, t in long_texts}
    assert bpe.tokenize(docs, bpe.public_vocabulary()).where("not exact").count() == 0


def test_runs_merge_and_verify():
    import numpy as np

    rng = np.random.default_rng(6)
    log, seen = repeats.Runs(), set()
    for _ in range(40):
        h, g = repeats._ordered(rng.integers(0, 50, 30).astype(np.uint64), rng.integers(0, 3, 30).astype(np.uint32))  # hashes collide, checks tell
        assert log.has(h, g).tolist() == [(int(a), int(b)) in seen for a, b in zip(h, g, strict=True)]
        log.add(h, g)
        seen |= {(int(a), int(b)) for a, b in zip(h, g, strict=True)}
        assert all(len(a[0]) >= 2 * len(b[0]) for a, b in zip(log.runs, log.runs[1:]))


def test_op3_needs_its_index(spark, monkeypatch):
    """Without the streamed matches of later texts in the index of earlier ones, repeats are missed."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    text = "".join(rng.choice("abcdef ") for _ in range(70))
    rows = [(1, 0, b"", bytes([len(t)]), np.array([d]).tobytes(), t.encode()) for d, t in ((1, text), (2, text[5:] + "x"), (3, "y" + text[:-9]), (4, text[2:] + "z"))]
    bucket = rindex._rows(rindex._RUNS, rows)
    assert isinstance(bucket, pa.Table)
    found = rindex._matched(50)(bucket)
    monkeypatch.setattr(rindex.RunLengthIndex, "matching_statistics", lambda self, t, off, need=0: (np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)))
    less = rindex._matched(50)(bucket)
    count = lambda t: sum(np.bitwise_count(np.frombuffer(m, np.uint64)).sum() for m in t.column("masks").to_pylist())
    assert count(found) > count(less) > 0
