"""Packing and ORC against the tokenizers library itself."""

import random
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from compare import SF
from tokenizers import Tokenizer

from stocktake.llm import orcout, packing


def direct(path, end, text):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing_holds_each_id_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokenizer = Tokenizer.from_file(path)
    want = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    pieces = packing.pack(docs, path, 2).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for doc, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == want[doc].tobytes()
        assert all(p.doc_tokens == len(want[doc]) for p in own)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= 4096
        assert at == 4096 or at & (at - 1) == 0


def test_sum_of_squares_fills_the_level_that_lowers_the_squares():
    level = packing.SumOfSquares(10)
    for size in (6, 6, 4):
        level.place((0, 0, np.zeros(size), size))
    assert len(level.full) == 1 and level.count[6] == 1


def test_every_item_goes_where_the_squares_grow_least():
    """Against a search of all levels, with the squares counted anew."""
    r, window = random.Random(7), 24
    level = packing.SumOfSquares(window)

    def squares(count):
        return sum(int(n) ** 2 for n in count[1:window])

    for _ in range(600):
        size, before = r.randint(1, window - 1), level.count.copy()
        choices = []
        for h in [0, *(h for h in range(1, window - size + 1) if before[h])]:
            after = before.copy()
            after[h] -= h > 0
            after[h + size] += h + size < window
            choices.append(squares(after))
        level.place((0, 0, np.zeros(size, np.int32), size))
        assert squares(level.count) == min(choices)
    total = sum(len(p[2]) for w in level.full for p in w) + level.open_tokens
    assert sum(len(p[2]) for w in level.close() for p in w) == total


def test_open_windows_keep_only_their_own_ids():
    level = packing.SumOfSquares()
    ids = np.zeros(1_000_000, np.int32)
    level.add(1, ids[:5000])
    kept = level.levels[5000 - 4096][0][0][2]
    assert kept.base is None and kept.nbytes == 4 * (5000 - 4096)


def test_orc_reads_back_what_was_encoded(spark, awkward, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = tempfile.mkdtemp()
    orcout.write_orc(awkward, f"file://{out}/ids", path, 0, parts=3)
    found = orcout.digest_ids(orcout.read_orc(spark, f"file://{out}/ids")).orderBy("start").collect()
    assert len(found) == awkward.count()
    texts = defaultdict(list)
    for r in awkward.collect():
        texts[r.doc_id].append(zlib.crc32(direct(path, 0, r.text).tobytes()))
    start = 0
    for r in found:
        assert r.start == start and r.ids_crc32 in texts[r.doc_id]
        start += r.n_tokens
    assert [r.doc_id or 0 for r in found] == sorted(r.doc_id or 0 for r in found)
    assert orcout.lookup(spark, f"file://{out}/ids", 5).count() == 1
    orcout.write_orc(nothing, f"file://{out}/none", path, 0)
    assert orcout.read_orc(spark, f"file://{out}/none").count() == 0


def rows_scanned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_lookups_skip_row_groups(spark):
    """Of 30,000 documents with even ids in three files a lookup reads the row
    group that holds the id, and none where the Bloom filters exclude it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = f"file://{tempfile.mkdtemp()}/ids"
    docs = spark.range(30_000).selectExpr("2 * id AS doc_id", "concat('word ', id % 50) AS text")
    orcout.write_orc(docs, out, path, 0, parts=3)
    stride = int(orcout.ORC_OPTIONS["orc.row.index.stride"])
    assert [r.doc_id for r in orcout.lookup(spark, out, 40_000).collect()] == [40_000]
    assert 1 <= rows_scanned(orcout.lookup(spark, out, 40_000)) <= stride
    absent = [rows_scanned(orcout.lookup(spark, out, k)) for k in (10_001, 30_001, 50_001)]
    assert sorted(absent)[:2] == [0, 0]  # each is excluded but for one time in a hundred
    assert rows_scanned(orcout.lookup(spark, out, 1_000_000)) == 0


def test_awkward_rows_pack(awkward, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(awkward, path, 2).collect()
    texts = defaultdict(list)
    for r in awkward.collect():
        texts[r.doc_id].append(direct(path, 2, r.text).tobytes())
    assert {p.doc_id for p in pieces} == set(texts)
    for doc, wanted in texts.items():  # rows that share an id differ in length or are alike
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: (p.doc_tokens, p.start))
        assert sorted(b"".join(bytes(p.ids) for p in own if 4 * p.doc_tokens == len(w)) for w in set(wanted)) == sorted(w * wanted.count(w) if len(set(wanted)) < len(wanted) and len(w) < 4 * 4096 else w for w in set(wanted))
    assert packing.pack(nothing, path, 2).count() == 0
