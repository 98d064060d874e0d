"""Runs of words, token counts and whitening against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import SF
from tokenizers import Tokenizer

from stocktake.llm import counts, periodic, queries, whiten

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def plain_runs(words):
    """All runs, by trying every period."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            if words[at] != words[at + q]:
                at += 1
                continue
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            length = at + q - start
            own = words[start : start + length]
            if length >= max(6, 4 * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(docs):
    return np.array([w for d in docs for w in d], np.int64), np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)


def repeating(r, blocks=6):
    words = []
    for _ in range(r.randint(0, blocks)):
        if r.random() < 0.4:
            words += [r.randint(0, 3) for _ in range(r.randint(0, 10))]
        else:
            words += ([r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(1, 6))] * 30)[: r.randint(1, 30)]
    return words


def test_runs_equal_every_period_tried():
    r = random.Random(1)
    for _ in range(400):
        docs = [repeating(r) for _ in range(r.randint(1, 5))]
        want = [plain_runs(d) for d in docs]
        assert periodic.runs_of(*numbered(docs)) == want
        assert [periodic.Extensions(np.array(d, np.int64)).runs() for d in docs] == want


def test_runs_survive_hashes_that_agree(monkeypatch):
    """With a modulus of 5 most hashes of different words agree."""
    monkeypatch.setattr(periodic, "_PRIME", 5)
    r = random.Random(2)
    for _ in range(200):
        words = repeating(r, 3)
        own = periodic.Extensions(np.array(words, np.int64))
        for i, j in ((a, b) for a in range(len(words)) for b in range(a + 1, len(words))):
            size = own.forward(i, j)
            assert words[i : i + size] == words[j : j + size]
            size = own.backward(i, j)
            assert words[i - size : i] == words[j - size : j]


def test_lyndon_words_are_the_longest():
    r = random.Random(3)
    for _ in range(200):
        words = repeating(r, 3)
        for reverse in (False, True):
            key = [-w if reverse else w for w in words]
            for i, end in periodic.Extensions(np.array(words, np.int64)).lyndon_ends(reverse):
                smaller = [j for j in range(i + 1, len(key)) if key[j:] < key[i:]]
                assert end == (smaller[0] if smaller else len(key))


@pytest.mark.parametrize(("words", "want"), [([0] * 60_000, [(0, 60_000, 1)]), ([*range(15_000)] * 4, [(0, 60_000, 15_000)]), (list(range(60_000)), [])])
def test_runs_of_very_long_texts(words, want):
    assert periodic.runs_of(*numbered([words])) == [want]


def test_words_of_sliced_columns():
    column = pa.array(["a  b\tc\n", "", "  ", "é x \x0b y", None, " z w"])
    for at in range(len(column)):
        words, bounds = periodic.split_words(column.slice(at))
        own = [words.to_pylist()[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        assert own == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in column.to_pylist()[at:]]


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, k, q in found for i in range(s + q, s + k)}
    best = max(found, key=lambda f: (f[1], -f[0], -f[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_of_runs_equals_plain(spark):
    want = {r.doc_id: plain_digest(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op11_periodic_runs(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == want
    assert sum(r.n_runs > 0 for r in found) > 3


def test_runs_of_awkward_tables(spark, awkward, nothing):
    rows = periodic.find_runs(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.runs == [] for r in rows if r.doc_id != 5)
    assert {r.collapsed for r in rows if r.doc_id in (2, 3)} == {""}
    assert periodic.digest_runs(periodic.find_runs(nothing)).count() == 0
    line = spark.createDataFrame([(1, "x y  x y\tx y\nx y x z"), (1, "x y  x y\tx y\nx y x z"), (None, "t " * 6)], "doc_id long, text string")
    got = sorted((r.collapsed, [tuple(x) for x in r.runs]) for r in periodic.find_runs(line).collect())
    assert got == [("t", [(0, 6, 1)])] + [("x y z", [(0, 9, 2)])] * 2


def whole(text):
    return len(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False))


def hostile(r, n):
    parts = ["word", " ", "  ", "\n", "\n\n", "\t", "<|endoftext|>", "<|endof", "text|>", "'re", "'", "don't", "12", "é", "日本語", "😀", ".", "!!!", " " * 40, "x" * 60, " ", "\r\n"]
    return "".join(r.choice(parts) for _ in range(n))


def test_spliced_counts_equal_the_library():
    r = random.Random(5)
    tokenizer = Tokenizer.from_file(BYTES)
    for chunk, overlap in ((64, 16), (200, 40), (1000, 100)):
        own = counts.Counter(BYTES, chunk, overlap)
        for _ in range(60):
            text = hostile(r, r.randint(1, 600))
            assert own.spliced(text) == len(tokenizer.encode(text, add_special_tokens=False))
            assert own.count([text, "", "a b"]) == [len(tokenizer.encode(t, add_special_tokens=False)) for t in (text, "", "a b")]
        assert own.widened


@pytest.mark.parametrize("text", ["x" * 9_000, " " * 9_000, "\n" * 9_000, "日" * 5_000, "<|endoftext|>" * 900, "ab" * 3_000 + " " + "c" * 3_000, "!" * 5_000 + "a"])
def test_spliced_counts_without_a_place_to_cut(text):
    own = counts.Counter(BYTES, 1_000, 100)
    assert own.spliced(text) == whole(text)


def test_query_of_counts_equals_the_library(spark):
    tokenizer = Tokenizer.from_file(BYTES)
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False))
        want[r.doc_id] = (len((r.text or "").encode()), n, n > 1024)
    assert {r.doc_id: tuple(r)[1:] for r in queries.op12_token_counts(spark, SF).collect()} == want


def test_counts_of_awkward_tables(awkward, nothing):
    rows = counts.count_tokens(awkward, BYTES).collect()
    texts = {(r.doc_id, len((r.text or "").encode())): whole(r.text or "") for r in awkward.collect()}
    assert len(rows) == awkward.count()
    assert all(texts[r.doc_id, r.n_bytes] == r.n_tokens and r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert counts.count_tokens(nothing, BYTES).count() == 0


def plain_whitening(vectors):
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    v = np.cov(x.T, bias=True)
    values, own = np.linalg.eigh(v)
    order = np.argsort(-values)[:8]
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ own[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


def test_query_of_whitening_equals_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, share = plain_whitening([r.embedding for r in rows])
    found = {(r.vec_id, r.component): r for r in queries.op13_embedding_whitening(spark, SF).collect()}
    assert len(found) == 8 * len(rows)
    got = np.array([[found[r.vec_id, k].whitened for k in range(1, 9)] for r in rows])
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-9
    for i, r in enumerate(rows):
        for k in range(1, 9):
            own = found[r.vec_id, k]
            assert (own.n, own.deviation) == (n, deviation[i])
            assert abs(own.explained - share[k - 1]) < 1e-12 and own.identity_error < 1e-9


def test_summaries_merge_to_the_whole():
    x = np.random.default_rng(1).normal(1e5, 300, (1000, 6))
    whole_summary = whiten.Summary.of(x)
    parts = whiten.Summary(0, np.zeros(0), np.zeros(0))
    for at in (0, 1, 7, 500, 999):
        parts = parts.merged(whiten.Summary.of(x[at : {0: 1, 1: 7, 7: 500, 500: 999, 999: 1000}[at]]))
    assert parts.n == 1000
    assert np.allclose(parts.mean, whole_summary.mean, rtol=1e-14)
    assert np.allclose(parts.scatter, whole_summary.scatter, rtol=1e-12, atol=1e-6)


def test_whitening_of_awkward_tables(spark):
    kind = "vec_id long, embedding array<float>, label int, n long, v string, component int"
    tail = (1, 5, "v", 3)
    good = [(i, [float(i % 7), float(i * i % 11), 0.25], *tail) for i in range(40)]
    bad = [(50, None, *tail), (51, [1.0, None, 2.0], *tail), (52, [float("nan"), 0.0, 0.0], *tail), (53, [float("inf"), 0.0, 0.0], *tail), (54, [], *tail), (55, [1.0], *tail), (None, [2.0, 3.0, 0.25], *tail), (3, [3.0, 9.0, 0.25], *tail)]
    rows = whiten.whiten(spark.createDataFrame(good + bad, kind)).collect()
    assert {r.vec_id for r in rows} == {*range(40), None}
    assert len(rows) == 42 * 2 and {r.n for r in rows} == {42}  # the third dimension never varies
    assert max(r.identity_error for r in rows) < 1e-9
    assert whiten.whiten(spark.createDataFrame(bad[:5], kind)).count() == 0
    assert whiten.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whiten.whiten(spark.createDataFrame(good[:1], kind)).count() == 0
    assert whiten.whiten(spark.createDataFrame([good[0], good[0]], kind)).count() == 0


def test_deviation_stays_exact_beyond_64_bits(spark):
    big = float(1 << 40)
    rows = whiten.whiten(spark.createDataFrame([(1, [big]), (2, [-big]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    x = [(1 << 50) + 100_000, 100_000 - (1 << 50), 100_000]
    assert {r.vec_id: int(r.deviation) for r in rows} == {i + 1: (3 * x[i] - sum(x)) ** 2 for i in range(3)}
