"""Pieces behind a space are encoded without marks by a tokenizer of bytes."""

import random

import numpy as np
import public_tokenizers

from stocktake.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"abcXYZ019'’.,;!?%#$&*|<>_~-\"()", "é", "ß", "шар", "水", "ﬁ", "İ", "é", "́", "😀", "👩‍🔬", "​", "­", "�", "Ⅷ", "²", "'s", "'ll", "<|endoftext|>"]
SPACE = [" "] * 12 + ["\n", "  ", "\n\n", " \n", "\t", " ", "　", "\r\n", "\u0085"]


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(1, 9))) for _ in range(n)]


def check(own, texts):
    ids, offsets = own.encode(texts)
    want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, own.end] for t in texts]
    assert ids.tolist() == sum(want, [])
    assert offsets.tolist() == [0, *np.cumsum([len(w) for w in want]).tolist()]


def test_pieces_behind_a_space_need_no_mark(monkeypatch):
    own, marked = Encoder(PATH, 0), []
    joined = own._joined
    monkeypatch.setattr(own, "_joined", lambda pieces: marked.extend(pieces.to_pylist()) or joined(pieces))
    check(own, [" ".join(f"{a}{b}{k}" for a in ("été", "x-", "шар") for b in ("'s", "水") for k in range(50))])
    assert not [x for x in marked if x.startswith(" ")]


def test_hostile_pieces():
    r, own = random.Random(3), Encoder(PATH, 0)
    for seed in range(4):
        texts = ["".join(w + r.choice(SPACE) for w in words(100 * seed + k, r.randint(0, 400))) for k in range(12)]
        check(own, [*texts, "", " ", *[" ".join(words(seed, 9000))] * 2])


def test_pieces_whose_ends_are_not_told_get_marks(monkeypatch):
    """As where a token spans two pieces, or stands for no bytes of its own."""
    text = " ".join(f"w{k}x" for k in range(500))
    for wrong in (0, 2, 1 << 20):
        own, marked = Encoder(PATH, 0), []
        own.width[own.tokenizer.encode(" w", add_special_tokens=False).ids[0]] = wrong + 1
        joined = own._joined
        monkeypatch.setattr(own, "_joined", lambda pieces, own=joined, marked=marked: marked.extend(pieces.to_pylist()) or own(pieces))
        check(own, [text])
        assert " w7x" in marked


def test_tails_of_several_marks():
    own = Encoder(PATH, 0)
    tails = ["", ".", "...", "?!", ";", "|", "*&*", ".,;!?%#$&*|", "é.", "水,"]
    check(own, [" ".join(f"{w}{t}" for w in ("one", "été", "9", "水") for t in tails), "end.", ".", "...", "a.\nb!\n?"])
