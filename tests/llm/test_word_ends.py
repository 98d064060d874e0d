"""Words of letters are encoded without marks between them."""

import public_tokenizers

from stocktake.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [f"{a}{b}{c}" for a in ("Wör", "été", "шар", "水", "x") for b in "aeiouß" for c in ("n", "ing", "É", "ﬁ")]


def encoded(monkeypatch, words):
    own, marked = Encoder(PATH, 2), []
    joined = own._joined
    monkeypatch.setattr(own, "_joined", lambda pieces: marked.extend(pieces.to_pylist()) or joined(pieces))
    text = " ".join(words)
    ids, offsets = own.encode([text, text[::-1]])
    plain = [own.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in (text, text[::-1])]
    assert ids.tolist() == plain[0] + plain[1] and offsets.tolist() == [0, len(plain[0]), len(ids)]
    return marked


def test_words_of_letters_need_no_mark(monkeypatch):
    assert not [x for x in encoded(monkeypatch, LETTERS) if x.strip().isalpha()]


def test_letters_whose_lower_case_is_none(monkeypatch):
    marked = encoded(monkeypatch, [*LETTERS, "İstanbul", "DİYAR"])
    assert " İstanbul" in marked
    encoded(monkeypatch, [*LETTERS, "a1", "1a2", "b-c", "d's", "é", "x̧y", "9", "</w>", "a</w>"])
