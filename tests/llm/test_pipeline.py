"""The corpus pipeline on a small corpus with planted cases."""

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from compare import SF
from test_near import brute
from test_texts import Substrings, lcs, longest_phrases, parsed_stream, plain_weight
from tokenizers import Tokenizer

from stocktake.llm import decontam, langid, toxicity
from stocktake.llm.common import Workspace
from stocktake.llm.textnum import Words


def test_stages_drop_what_they_should(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first()
    base = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(4)
    words = [f"lexeme{i}" for i in range(400)]
    clean = " ".join(r.choices(words, k=120))
    rows = [(90_001, clean), (90_002, clean), (90_003, clean + " tail"), (90_004, "12 34"), (90_005, " ".join(r.choices(words, k=80)) + " " + bench.text + " " + " ".join(r.choices(words, k=80))), (90_006, " ".join(r.choices(words, k=90)))]
    more = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) AS lang", "'x' AS source", "cast(length(text) as bigint) AS n_chars")
    work, docs = Workspace(spark, "test-pipeline"), base.unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = work.save(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        docs = out
    left = {x.doc_id for x in docs.where("doc_id > 90000").collect()}
    assert left == {90_001, 90_006}
    pieces = corpus_pipeline.packed(spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def small_corpus(spark):
    """Documents of the smallest table up to 1,500 letters, with planted copies,
    leaks, insults and texts in no language."""
    r = random.Random(21)
    base = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    some = [x.text for x in base.where("length(text) > 300").orderBy("doc_id").limit(20).collect()]
    items = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").limit(6).collect()]
    noise = ["".join(r.choice("qwertzuiopasdfghjklyxcvbnm ") for _ in range(400)), "Это обычный русский текст о реках, горах и погоде на завтра. " * 3, "😀🚀", "12 34"]
    texts = [*some[:8], *(" ".join(t.split()[:-2]) for t in some[8:14]), *(f"{some[14 + k]} {item} {some[k]}" for k, item in enumerate(items)), *(f"{t[:200]}. you are an idiot and a moron, you worthless scum. {t[200:500]}" for t in some[:4]), *noise]
    more = spark.createDataFrame(list(enumerate(texts, 90_000)), "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) AS lang", "'x' AS source", "cast(length(text) as bigint) AS n_chars")
    return base.unionByName(more)


def plain_language(rows, training):
    known = {lang: Substrings(t) for lang, t in training.items()}
    cost = {lang: np.log2(max(2, len(t))) for lang, t in training.items()}

    def explained(text):
        letters = sum(c.isalpha() for c in text or "")
        if not letters:
            return False
        stream = parsed_stream(text)
        found = {lang: sum(longest_phrases(stream[at : at + langid.SEGMENT], k) for at in range(0, len(stream), langid.SEGMENT)) for lang, k in known.items()}
        return min((n - langid.FORGIVEN) * cost[lang] for lang, n in found.items()) <= langid.STRANGE * letters

    return {i for i, t in rows if explained(t)}


def plain_leaks(rows, items):
    """Ids of rows in which some region that a window stands for holds an item."""
    out = set()
    for i, text in rows:
        words = Words([text or ""]).hashes
        for item in items:
            slack = len(item.words) if len(item.words) > decontam.PROBE else decontam.STRIDE
            wanted, answer = item.words.tolist(), item.words[item.answer :].tolist()
            for at in range(0, len(words), decontam.STRIDE):
                region = words[max(0, at - slack) : at + decontam.WINDOW + slack].tolist()
                if len(set(region) & set(wanted)) < 0.5 * len(set(wanted)):
                    continue
                whole = item.answer > 0 and any(region[k : k + len(answer)] == answer for k in range(len(region)))
                if decontam.is_leak(item, lcs(wanted, region) / len(wanted), whole):
                    out.add(i)
    return out


def test_stages_equal_plain_versions_one_after_another(spark):
    """Each stage on what the one before kept, against a version of its rule that
    takes rows one by one, or all pairs, or all windows."""
    docs = small_corpus(spark)
    work = Workspace(spark, "test-plain")
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: [(x.doc_id, x.text) for x in df.collect()]
    gone = {}

    def step(name, want):
        nonlocal docs
        before = {i for i, _ in pairs(docs)}
        docs = work.save(stages[name](spark, docs, SF), name)
        left = {i for i, _ in pairs(docs)}
        assert left == want, name
        gone[name] = before - left

    step("language", plain_language(pairs(docs), langid.training_text(docs)))
    grammar = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    a, b = grammar.coefficients
    step("toxicity", {i for i, t in pairs(docs) if 1 / (1 + np.exp(-(a + b * np.log1p(plain_weight(grammar, t))))) < toxicity.THRESHOLD})
    classes = brute(pairs(docs))
    step("near_duplicates", {i for i, (least, _) in classes.items() if i == least})
    leaks = plain_leaks(pairs(docs), decontam.items_of(spark.read.parquet(f"{SF}/benchmark.parquet")))
    step("decontamination", {i for i, _ in pairs(docs)} - leaks)
    assert {90_024 + k for k in range(4)} <= gone["language"] and {90_020 + k for k in range(4)} <= gone["toxicity"]
    assert {90_000 + k for k in range(8)} <= gone["near_duplicates"] | gone["toxicity"] and {90_014 + k for k in range(6)} <= gone["decontamination"] | gone["toxicity"] | gone["near_duplicates"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, corpus_pipeline.END], "<u4") for i, t in pairs(docs)}
    taken = {i: 0 for i in want}
    for p in corpus_pipeline.packed(spark, docs, SF).collect():
        assert p.ids_crc32 == zlib.crc32(want[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(want[p.doc_id])
        taken[p.doc_id] += p.length
    assert taken == {i: len(ids) for i, ids in want.items()}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_and_empty_tables(spark, awkward, nothing, name, stage):
    out = stage(spark, awkward, SF)
    if name == "packing":
        assert out.select("doc_id").distinct().count() == 8
    else:
        assert out.columns == awkward.columns
        ids = sorted(x.doc_id or 0 for x in out.collect())
        # without a letter: 2 (null), 3 (empty), 4 and the null text without an id
        assert ids == {"language": [0, 1, 1, 5, 6, 7], "toxicity": [0, 0, 1, 1, 2, 3, 4, 5, 6, 7], "near_duplicates": [0, 0, 1, 2, 3, 4, 5, 6, 7], "decontamination": [0, 0, 1, 1, 2, 3, 4, 5, 6, 7]}[name]
    assert stage(spark, nothing, SF).count() == 0
