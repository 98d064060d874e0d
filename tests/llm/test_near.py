"""Near duplicates against all pairs."""

import random
import re

from stocktake.llm import near


def shingle_set(text):
    words = re.findall(r"[^\W_]+", text.lower())
    if len(words) < near.SHINGLE_WORDS:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(25):
        base = r.choices(vocabulary, k=r.randint(30, 150))
        docs.append(base)
        for _ in range(r.randint(0, 5)):
            other = list(base)
            for _ in range(r.randint(0, 4)):
                other[r.randrange(len(other))] = r.choice(vocabulary)
            docs.append(other)
    return [(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, "tiny text"), (901, "tiny text"), (902, "Tiny, text!"), (903, None), (904, ""), (905, "!!!"), (906, "!!!")]


def brute(rows):
    sets = {i: shingle_set(t or "") for i, t in rows}
    raw = dict(rows)
    linked = {i: set() for i in sets}
    for i in sets:
        for j in sets:
            if i < j:
                a, b = sets[i], sets[j]
                same = 5 * len(a & b) >= 4 * len(a | b) if a and b else bool(not a and not b and raw[i] and raw[i] == raw[j])
                if same:
                    linked[i].add(j)
                    linked[j].add(i)
    out = {}
    for i in sets:
        seen, waiting = {i}, [i]
        while waiting:
            for j in linked[waiting.pop()] - seen:
                seen.add(j)
                waiting.append(j)
        out[i] = (min(seen), len(linked[i]))
    return out


def test_classes_and_links_equal_all_pairs(spark):
    rows = corpus()
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == brute(rows)
    assert sum(r.keeper for r in found) == len({r.class_id for r in found})


def families(seed=7, count=15, members=50, fringe=5):
    """Families of variants of one text, and a few documents linked to a single
    variant each: too few to crowd a node of the trie."""
    r = random.Random(seed)
    out = []
    for f in range(count):
        docs = []
        for k in range(members):
            docs.append([f"f{f}b{i}" for i in range(400)])
            docs[-1][r.randrange(200)] = f"m{f}x{k}"
        for k in range(fringe):
            other = list(docs[7 * k + 5])
            for at in range(210, 210 + 8 * 22, 22):
                other[at] = f"y{f}x{k}x{at}"
            docs.append(other)
        out.append([(1000 * f + i, " ".join(d)) for i, d in enumerate(docs)])
    return out


def test_documents_linked_to_one_member_of_a_family(spark):
    groups = families()
    expected = {i: x for rows in groups for i, x in brute(rows).items()}
    assert sum(links == 1 for _, links in expected.values()) > 50
    found = near.near_duplicates(spark.createDataFrame(sum(groups, []), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == expected


def borderline(seed=21, count=40, members=8):
    """Families whose texts are about 0.8 alike."""
    r = random.Random(seed)
    rows = []
    for f in range(count):
        base = [f"b{f}x{i}" for i in range(r.randint(80, 200))]
        for k in range(members):
            other = list(base)
            for at in r.sample(range(len(other)), r.randint(1, max(1, len(other) // 60))):
                other[at] = f"z{f}x{k}x{at}"
            rows.append((100 * f + k, " ".join(other)))
    return rows


def test_recall_of_borderline_links(spark):
    rows = borderline()
    expected = brute(rows)
    found = {x.doc_id: x.n_links for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links, got = sum(n for _, n in expected.values()), sum(found.values())
    assert links > 500 and got >= 0.99 * links and all(found[i] <= expected[i][1] for i in found)


def test_one_large_class_of_different_texts(spark, monkeypatch):
    """Several blocks, by rows and by shingles."""
    monkeypatch.setattr(near, "BLOCK", 100)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 9_000)
    words = [f"base{i}" for i in range(120)]
    rows = [(i, " ".join(words[: i % 100 + 10] + [f"own{i}"] + words[i % 100 + 11 :])) for i in range(400)]
    rows = [(i, t) for i, t in rows] + [(1000 + i, rows[0][1]) for i in range(50)]
    expected = brute(rows)
    found = {x.doc_id: (x.class_id, x.n_links) for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == expected


def test_depth_reaches_recall():
    depth = near.depth_for(0.9995, 20, 0.8)
    assert 1 - (1 - 0.8**depth) ** 20 >= 0.9995 > 1 - (1 - 0.8 ** (depth + 1)) ** 20


def test_awkward_rows(spark, awkward, nothing):
    kept = near.keep_one_of_each(awkward).select("doc_id", "text").collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, -1, 1, 2, 3, 4, 5, 6, 7]
    assert near.keep_one_of_each(nothing).count() == 0
    assert near.near_duplicates(nothing).count() == 0
