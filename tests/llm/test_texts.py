"""Language, toxicity and benchmark leaks: held-out accuracy, brute force and
planted cases."""

import random
import re

import numpy as np
import pytest
from compare import SF

from stocktake.llm import decontam, langid, toxicity
from stocktake.llm.common import Workspace, held_out
from stocktake.llm.textnum import Words

SF2 = SF.replace("0.001", "0.01")


# 144 labelled toxic documents are held out here; the smaller tables have a few
SF3 = SF.replace("0.001", "0.1")


def docs(spark, sf_dir=SF2):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def learned(spark):
    return toxicity.learn(docs(spark, SF3), spark.read.parquet(f"{SF3}/labels.parquet"))


def longest_phrases(text, known):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) + 1 and text[i : i + k] in known:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_suffix_automaton_knows_all_substrings():
    text = "abracadabra cad"
    step = langid.suffix_automaton(text)

    def known(s):
        at = 0
        for c in s:
            if c not in step[at]:
                return False
            at = step[at][c]
        return True

    r = random.Random(1)
    for _ in range(500):
        s = "".join(r.choice("abcdr ") for _ in range(r.randint(1, 5)))
        assert known(s) == (s in text)


def parsed_stream(text):
    """Letters, one space for each run of others, and one at the end."""
    out, before = "", False
    for c in text.lower():
        out += c if c.isalpha() else " " if before else ""
        before = c.isalpha()
    return out + " "


class Substrings:
    def __init__(self, text):
        self.text = text

    def __contains__(self, s):
        return s in self.text


def test_phrases_and_predictions_equal_a_plain_parser():
    r = random.Random(5)
    texts = {k: " " + " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(200)) + " " for k, letters in (("a", "abcd e"), ("b", "abfgh"), ("c", "cdxyé"))}
    docs = ["".join(r.choice("abcdefghxyé zq.,1\n") for _ in range(n)) for n in (0, 1, 7, 60, 511, 512, 513, 1500)] + ["zzzz", "...", ".ab. "]
    parser = langid.CrossParser(texts)
    found, letters = parser.phrases(docs)
    for i, doc in enumerate(docs):
        stream = parsed_stream(doc)
        assert letters[i] == sum(c.isalpha() for c in doc)
        plain = [sum(longest_phrases(stream[at : at + langid.SEGMENT], Substrings(t)) for at in range(0, len(stream), langid.SEGMENT)) for t in texts.values()]
        assert found[i].tolist() == plain
        assert (found[i] * parser.cost).argmin() == np.argmin([n * np.log2(len(t)) for n, t in zip(plain, texts.values(), strict=True)])


def many_languages(r, latin, wide, size):
    def text(letters):
        words = ["".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(size // 20)]
        return " " + " ".join(r.choices(words, k=size // 4))[:size] + " "

    out = {f"l{k}": text(r.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñçøå", 26)) for k in range(latin)}
    return out | {f"w{k}": text([chr(0x4E00 + 3000 * k + i) for i in range(wide)] + ["\U00020000", "\U00020001"]) for k in range(2)}


def test_sparse_automata_equal_full_ones(monkeypatch):
    r = random.Random(8)
    texts = many_languages(r, 3, 300, 4_000)
    docs = [t[100:900] for t in texts.values()] + ["", "zzz", "\U00020000\U00020001 \U00020002", "😀 x"]
    full = langid.CrossParser(texts)
    monkeypatch.setattr(langid, "FULL_ENTRIES", 0)
    sparse = langid.CrossParser(texts)
    assert {type(t) for t in full.tables} == {langid.Full} and {type(t) for t in sparse.tables} == {langid.Sparse}
    for a, b in zip(full.phrases(docs), sparse.phrases(docs), strict=True):
        assert (a == b).all()


def test_many_languages_take_bounded_memory():
    """Sixty languages, two of them with large alphabets; a full table of each
    would take 20 MB for one of the narrow ones' size and 300 for a wide one."""
    texts = many_languages(random.Random(9), 58, 3_000, 20_000)
    parser = langid.CrossParser(texts)
    size = sum(sum(x.nbytes for x in vars(t).values()) for t in parser.tables)
    assert len(parser.tables) == 60 and size < 180 << 20
    own = [t for t in parser.tables if isinstance(t, langid.Sparse)]
    assert sum(len(t.owner) for t in own) < 1.3 * sum((t.owner >= 0).sum() for t in own)
    sample = {k: t[500:1500] for k, t in texts.items()}
    found, _ = parser.phrases(list(sample.values()))
    assert [parser.langs[i] for i in (found * parser.cost).argmin(axis=1)] == list(sample)


def test_emojis_are_no_letters(spark):
    table = docs(spark)
    rows = spark.createDataFrame([(1, "😀🚀😀"), (2, "🀄"), (3, "12 😀 !!"), (4, "the river 😀 and the hills"), (5, "𠀀𠀁")], "doc_id long, text string")
    training = langid.training_text(table)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(rows, training).collect()}
    assert {i for i, (lang, _) in found.items() if lang == "und"} == {1, 2, 3}
    assert all(found[i][1] == 0 for i in (1, 2, 3))
    assert not {r.doc_id for r in langid.drop_unidentified(rows, training).collect()} & {1, 2, 3}
    assert Words(["hello😀world again"]).offsets.tolist() == [0, 3]


def test_rejected_are_strange_texts_only(spark):
    table = docs(spark)
    training = langid.training_text(table)
    r = random.Random(3)
    noise = ["".join(r.choice("qwertzuiopasdfghjklyxcvbnm ") for _ in range(400)), "Это обычный русский текст о реках, горах и погоде на завтра. " * 4, "12 34", None]
    more = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    kept = langid.drop_unidentified(table.select("doc_id", "text").unionByName(more), training)
    assert kept.where("doc_id >= 10000000").count() == 0
    lettered = table.where(r"text rlike '\\p{L}'").count()
    assert kept.count() == lettered


def test_language_held_out_accuracy(spark):
    table = docs(spark)
    found = langid.identify(table, langid.training_text(table)).where("held_out")
    rows = found.join(table.select("doc_id", "lang", "text"), "doc_id").where("lang IS NOT NULL AND length(text) > 60").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(awkward, nothing):
    training = langid.training_text(awkward)
    found = {r.doc_id: r.lang_pred for r in langid.identify(awkward, training).collect() if r.doc_id}
    assert found[2] == found[3] == found[4] == "und"
    assert langid.drop_unidentified(awkward, training).count() == 6
    assert langid.identify(nothing, {}).count() == 0


HARMLESS = {
    "negated": "you are not an idiot. ",
    "reported": 'He said: "you are an idiot". ',
    "waste": "The garbage truck comes on Monday. ",
    "plainly waste": "They collect the garbage on Monday. ",
    "somebody's waste": "Take your trash outside. ",
    "sport": "He was the loser of the final. ",
    "circus": "The clown made children laugh at the party. ",
    "prose": "The river runs past the hills and the old town. ",
}


@pytest.mark.parametrize("kind", HARMLESS)
def test_harmless_clauses_do_not_add_up(learned, kind):
    matcher = toxicity.Matcher(learned)
    scores = matcher.scores([HARMLESS[kind] * n for n in (1, 3, 20, 200)])
    assert max(scores) < 0.7 and max(scores) - min(scores) < 1e-9


@pytest.mark.parametrize("insult", ["you are an idiot", "you are not wrong, idiot", "You are a worthless piece of trash", "you clown", "I hate you and everyone like you", "I will kill you", "du bist ein Idiot"])
def test_one_insult_counts_in_any_company(learned, insult):
    matcher = toxicity.Matcher(learned)
    filler = "".join(HARMLESS[k] for k in ("prose", "waste", "negated")) * 40
    assert min(matcher.scores([f"{insult}.", f"{filler}{insult}. {filler}"])) >= 0.7


def plain_weight(grammar, text):
    """A document's weight, clause by clause, with each machine run by itself."""
    gravest, plain, nouns = 0.0, {}, {}
    for clause in re.split(r"[.!?;\n]", text.lower()):
        tokens = re.findall(r"[^\W_]+|[\"“”«»„:,]", clause)
        classes, arcs = grammar.read(clause)
        tail = (toxicity.negation_transducer(), toxicity.reported_transducer())
        total = 0.0
        for parts in ((toxicity.insult_transducer(), toxicity.target_transducer(), *tail), (toxicity.predication_transducer(), toxicity.target_transducer(), *tail), (toxicity.threat_transducer(), *tail)):
            state = [0] * len(parts)
            for token, c, w in zip(tokens, classes, arcs, strict=True):
                factors = [p.factor[s][c] for p, s in zip(parts, state, strict=True)]
                weight = float(np.prod(factors)) * w
                total += weight
                if weight and (factors[-1] * factors[-2]) == 1 and not (c == toxicity.NOUN and factors[0] < 1):
                    plain[token] = max(plain.get(token, 0), weight)
                elif c == toxicity.NOUN and factors[-1] * factors[-2] == 1:
                    nouns[token] = w
                state = [p.step[s][c] for p, s in zip(parts, state, strict=True)]
        gravest = max(gravest, total)
    return max(gravest, sum(plain.values()) + (sum(w for t, w in nouns.items() if t not in plain) if plain else 0))


def test_documents_weigh_as_their_clauses(learned):
    r = random.Random(12)
    parts = ["you", "are", "not", "an", "idiot", "the", "clown", "said", ":", '"', ",", "kill", "him", "your", "garbage", "moron", "river", "word", ".", "!", "\n", "that", "du", "trash", "scum"]
    texts = [" ".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(400)]
    found = toxicity.Matcher(learned).weights(texts)
    assert np.allclose(found, [plain_weight(learned, t) for t in texts])
    assert len(set(np.round(found, 3))) > 20


def test_threat_verbs_are_learned(spark):
    rows = [(i, f"word{i} I will zork you and zork them word{i % 7}", 1) for i in range(40)] + [(100 + i, f"the river{i} and the hills", 0) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert "zork" in grammar.threats - toxicity.THREATS
    assert "zork" not in grammar.words and "river" not in grammar.threats


def test_toxicity_held_out(spark, learned):
    table, labels = docs(spark, SF3), spark.read.parquet(f"{SF3}/labels.parquet")
    found = toxicity.score(table, learned).where("held_out")
    rows = found.join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert toxic and sum(r.predicted for r in toxic) / len(toxic) > 0.8
    assert sum(r.predicted for r in clean) / len(clean) < 0.05


def every_path(grammar, clause):
    """The sum over all paths: each chooses one match; every transducer runs by
    itself."""
    classes, weights = grammar.read(clause)
    tail = (toxicity.negation_transducer(), toxicity.reported_transducer())
    total = 0.0
    for parts in ((toxicity.insult_transducer(), toxicity.target_transducer(), *tail), (toxicity.predication_transducer(), toxicity.target_transducer(), *tail), (toxicity.threat_transducer(), *tail)):
        for chosen in range(len(classes)):
            path = weights[chosen]
            for part in parts:
                state = 0
                for c in classes[:chosen]:
                    state = part.step[state][c]
                path *= part.factor[state][classes[chosen]]
            total += path
    return total


def test_composed_machines_equal_all_paths():
    grammar, r = toxicity.Grammar(), random.Random(9)
    some = ["idiot", "scum", "kill", "töten", "dich", "you", "he", "not", "kein", "said", "that", ":", '"', "river", "and", "the"]
    for _ in range(400):
        clause = " ".join(r.choices(some, k=r.randint(0, 14)))
        assert abs(grammar.weigh(clause) - every_path(grammar, clause)) < 1e-9


@pytest.mark.parametrize("size", [0, 10, 100, 1000])
@pytest.mark.parametrize("own", [False, True])
def test_clauses_count_whatever_the_length(learned, size, own):
    grammar = learned if own else toxicity.Grammar()
    around = "rivers run along wide valleys and the weather stays mild. " * (size // 20)
    score = lambda text: toxicity.Matcher(grammar).scores([around + text + ". " + around])[0]
    for text in ("you are an idiot", "I will kill you", "ich werde dich töten", "du bist ein Idiot und Abschaum", "they are scum, you are trash"):
        assert score(text) >= 0.7, text
    harmless = ["you are not an idiot", "He said: you are an idiot", '"you are an idiot", she wrote', "I will not kill you", "he said that you are a moron", "the trash is full", "we kill time before you arrive", "the path to the lake is worth a walk and you never lose the view", "Das Wort steht im Worte der Woche", "I lost my keys lower down"]
    for text in harmless:
        assert score(text) < 0.7, text


def test_only_a_threat_with_its_object_is_one():
    grammar = toxicity.Grammar({}, {})
    assert grammar.weigh("i will kill you") == toxicity.THREAT_WEIGHT
    assert grammar.weigh("i will kill time and see you") == 0
    assert grammar.weigh("the river is wide") == 0
    assert grammar.weigh("i will not kill you") == pytest.approx(toxicity.THREAT_WEIGHT * toxicity.NEGATED)


def test_chance_words_and_copies_teach_nothing(spark):
    """Words of one toxic text that was copied, and prefixes of one insult."""
    r = random.Random(1)
    plain = [f"calm{i}" for i in range(200)]
    copy = " ".join(f"chance{i}" for i in range(40)) + " grumble"
    rows = [(i, copy, 1) for i in range(30)]
    rows += [(100 + i, " ".join(r.choices(plain, k=30) + ["grumble"] + r.choices(plain, k=9)), 1) for i in range(40)]
    rows += [(200 + i, " ".join(r.choices(plain, k=40)), 0) for i in range(100)]
    words, stems, _ = toxicity.lexicon(spark.createDataFrame(rows, "id long, text string, toxic int"), Workspace(spark, "lexicon"))
    assert set(words) == {"grumble"} and stems == {}
    forms = [(300 + i, " ".join(r.choices(plain, k=30)) + f" grumbl{'abcdefgh'[i % 8]} " + r.choice(plain), 1) for i in range(40)]
    _, stems, _ = toxicity.lexicon(spark.createDataFrame(rows[30:] + forms, "id long, text string, toxic int"), Workspace(spark, "lexicon"))
    assert set(stems) == {"grumbl"}


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    grammar = toxicity.learn(awkward, labels)
    assert toxicity.score(awkward, grammar).count() == 10
    assert toxicity.drop_toxic(awkward, grammar).columns == awkward.columns
    assert toxicity.score(nothing, toxicity.learn(nothing, labels.limit(0))).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_lcs_equals_the_plain_table():
    r = np.random.default_rng(5)
    for _ in range(40):
        a, b = r.integers(0, 6, 20).astype(np.uint64), r.integers(0, 6, 35).astype(np.uint64)
        assert decontam.lcs_length(a, b) == lcs(a.tolist(), b.tolist())


def test_leaks_are_found_and_clean_documents_stay(spark):
    bench = spark.read.parquet(f"{SF2}/benchmark.parquet")
    items = bench.where("length(text) > 80").orderBy("item_id").limit(6).collect()
    r = random.Random(2)
    filler = [f"filler{i}" for i in range(500)]
    rows = [(i, " ".join(r.choices(filler, k=150))) for i in range(60)]
    for k, item in enumerate(items):
        words = item.text.split()
        changed = [w if i % 9 else "other" for i, w in enumerate(words)]
        for d, body in ((1000 + k, words), (2000 + k, changed)):
            rows.append((d, " ".join(r.choices(filler, k=70) + body + r.choices(filler, k=33))))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontam.find_leaks(table, bench).collect()}
    for k, item in enumerate(items):
        assert (1000 + k, item.item_id) in found
        assert (2000 + k, item.item_id) in found
    assert not [d for d, _ in found if d < 1000]
    assert {x.doc_id for x in decontam.drop_leaks(table, bench).collect()} == set(range(60))


@pytest.mark.parametrize("filler", [20, 90])
def test_paraphrases_of_an_item_in_a_third_of_the_documents(spark, filler):
    r = random.Random(4)
    item = [f"item{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices([f"filler{k}" for k in range(400)], k=filler + 40))) for i in range(200)]
    for i in range(100):  # in ten of the copies the last eight words are others, so they are the rarest
        body = item[:32] + ([f"near{i}x{k}" for k in range(8)] if i < 10 else item[32:])
        rows.append((1000 + i, " ".join(r.choices([f"filler{k}" for k in range(400)], k=filler) + body)))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {x.doc_id for x in decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == set(range(1000, 1100))


def planted(seed, count=40):
    """Items, and documents that hold parts of them: cut, shuffled in places,
    with words put in or replaced."""
    r = random.Random(seed)
    common = [f"w{i}" for i in range(120)]
    items = [" ".join(r.choices(common, k=5) + [f"i{k}x{j}" for j in range(r.randint(12, 40))] + r.choices(common, k=5)) + ". The answer is " + f"a{k} b{k}" for k in range(6)]
    rows = []
    for d in range(count):
        words = r.choice(items).replace(".", "").split()
        kind = r.random()
        if kind < 0.5:
            words = [w if r.random() > kind * 0.7 else r.choice(common) for w in words]
        elif kind < 0.75:
            at = r.randint(0, len(words))
            words = words[at:] + words[:at]
        else:
            words = [x for w in words for x in ([w, r.choice(common)] if r.random() < 0.15 else [w])]
        rows.append((d, " ".join(r.choices(common, k=r.randint(0, 150)) + words + r.choices(common, k=r.randint(0, 150)))))
    rows += [(1000 + d, " ".join(r.choices(common, k=200))) for d in range(20)]
    return items, rows


def test_leaks_equal_a_search_of_all_windows(spark):
    """Plain longest common subsequences over every region that any window
    could be checked on."""
    wanted, got, clean = 0, 0, 0
    items, rows = planted(11)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    listed = decontam.items_of(bench)
    for d, text in rows:
        words = Words([text]).hashes
        for item in listed:
            slack = len(item.words) if len(item.words) > decontam.PROBE else decontam.STRIDE
            leak = False
            for at in range(0, len(words), decontam.STRIDE):
                region = words[max(0, at - slack) : at + decontam.WINDOW + slack].tolist()
                cover = lcs(item.words.tolist(), region) / len(item.words)
                answer = item.words[item.answer :].tolist()
                whole = any(region[i : i + len(answer)] == answer for i in range(len(region)))
                leak |= decontam.is_leak(item, cover, item.answer > 0 and whole)
            wanted += leak
            got += leak and (d, item.item_id) in found
            clean += not leak and (d, item.item_id) in found
    assert wanted > 25 and got >= 0.95 * wanted and clean == 0


def test_many_items_take_several_rounds(spark, monkeypatch):
    items, rows = planted(12)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    once = {(x.doc_id, x.item_id) for x in decontam.find_leaks(table, bench).collect()}
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 2)
    monkeypatch.setattr(decontam, "ROUND_BYTES", 1)
    assert len(decontam._rounds(decontam.prepare(table, bench)[3])) > 1
    assert once == {(x.doc_id, x.item_id) for x in decontam.find_leaks(table, bench).collect()}
    assert {x.doc_id for x in decontam.drop_leaks(table, bench).collect()} == {d for d, _ in rows} - {d for d, _ in once}


def test_an_answer_counts_only_whole():
    answer, region = np.array([5, 6], np.uint64).tobytes(), np.array
    assert decontam._holds(region([1, 5, 6], np.uint64).tobytes(), answer)
    assert not decontam._holds(region([5, 1, 6], np.uint64).tobytes(), answer)
    assert not decontam._holds(region([5, 6], np.uint64).tobytes(), b"")


def test_frequencies_count_passages(spark):
    texts = ["a b a a " * 40, "a c", "c " * 64 + "c b", ""]
    words = Words(["a b c"]).hashes
    terms = np.sort(words)
    held, total = decontam.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), terms)
    assert total == 6
    assert [held[np.searchsorted(terms, w)] for w in words] == [4, 4, 3]


def test_leaks_of_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "a plain sentence about rivers and hills"), (2, None), (None, "x y")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.find_leaks(awkward, bench).collect()) == [1, 1]
    assert decontam.drop_leaks(awkward, bench).columns == awkward.columns
    assert decontam.find_leaks(nothing, bench).count() == 0
    assert decontam.find_leaks(awkward, bench.limit(0)).count() == 0


def test_held_out_is_a_third(spark):
    n = spark.range(3000).where(held_out("id")).count()
    assert 900 < n < 1100
