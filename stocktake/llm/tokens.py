"""Token ids of whole texts, each distinct word encoded once per slice.

Both tokenizers of this package split a text at a space that stands between two
characters which are not white space, before and after a line end, and between a
letter or digit and a punctuation mark, and never join across these places.  So
a text is cut there, Arrow finds the distinct pieces, the tokenizer encodes
those, and numpy lays the ids out again.  Texts with other runs of white space
are encoded whole.  The ids equal those of the whole text either way (tested).
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import resident

#: bytes of text encoded at once; bounds memory
ENCODE_CHARS = 1_200_000
#: distinct pieces whose ids a worker remembers, and the bytes of their names
REMEMBERED, REMEMBERED_BYTES = 300_000, 8 << 20
#: pieces that the tokenizer holds at once
AT_ONCE = 20_000
_TAIL = ".,;!?%#$&*|"
_OTHER = r"\t\x{0b}\x{0c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: runs of white space that the cuts would change
_RUNS = rf" [ \n{_OTHER}]|\n\n[ \n]|\n\n$|\n[{_OTHER}]|[{_OTHER}]\n"
_VISIBLE = r"[^\s\pZ\pC~]+"
_LETTERS = r"^ ?\pL+$"
_SPACED = rf"^ {_VISIBLE}$"
#: marks that stand for themselves between pieces: a line end, or one for
#: tokenizers that drop white space
_MARKS = ("\n", " ~ ")


def _tokenizer(path: str):
    # a task has one core; threads of its own would only hold memory of their own
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings inside a text are ordinary text
    return tokenizer


def _cuts_bytes(tokenizer) -> bool:
    """Whether tokens stand for the bytes of a text as it is, one letter a byte."""
    from tokenizers.pre_tokenizers import ByteLevel

    cutter = tokenizer.pre_tokenizer
    return tokenizer.normalizer is None and isinstance(cutter, ByteLevel) and cutter.use_regex and not cutter.add_prefix_space


def _ragged(lists: list[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum())), size


def _gather(flat: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs ``flat[place:place + size]``, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(place - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _after(names: pa.Array, stems: pa.Array) -> pa.Array:
    """What follows each stem in its name, as large strings."""
    size, skip = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (names, stems))
    if not size.sum():
        return names
    bounds = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names)]
    data = _gather(np.frombuffer(names.buffers()[2], np.uint8), bounds + skip, size - skip)
    return pa.LargeStringArray.from_buffers(len(names), pa.py_buffer(np.concatenate(([0], np.cumsum(size - skip)))), pa.py_buffer(data))


class Encoder:
    """Ids of texts by a tokenizer file; ``end`` is appended to every text."""

    def __init__(self, path: str, end: int) -> None:
        self.tokenizer, self.end = _tokenizer(path), end
        ids = [self.tokenizer.encode(f"a{mark}b", add_special_tokens=False).ids[1:-1] for mark in _MARKS]
        self.mark, self.mark_ids = next(((m, i) for m, i in zip(_MARKS, ids, strict=True) if len(i) == 1), ("", []))
        #: for each id, whether its token ends a word
        self.closing = np.zeros(0, bool)
        #: for each id, the bytes that its token stands for
        self.width = np.zeros(0, np.int64)
        #: pieces that need no mark between them, and what joins them instead
        self.alone, self.joint = "", ""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix and self.mark == _MARKS[1]:
            vocabulary = self.tokenizer.get_vocab()
            self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closing[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.alone, self.joint = _LETTERS, " "
        elif self.mark == _MARKS[0] and _cuts_bytes(self.tokenizer):
            vocabulary = self.tokenizer.get_vocab()
            self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.width[list(vocabulary.values())] = [len(token) for token in vocabulary]
            self.alone = _SPACED
        self.known, self.again = pa.array([], pa.large_string()), np.zeros(0, bool)
        self.flat, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``plain``, for pieces that may stand in one text with the mark."""
        names = pieces.to_pylist()
        parts = [np.zeros(0, np.int32)]
        for low in range(0, len(names), AT_ONCE):
            flat = [self.mark.join(names[at : min(at + 4000, low + AT_ONCE)]) + self.mark for at in range(low, min(low + AT_ONCE, len(names)), 4000)]
            parts += [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(flat, add_special_tokens=False)]
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == self.mark_ids[0])
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _unmarked(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``plain``, for pieces that match ``alone``, which need no mark.  Where
        the pieces' ends can't be told from the ids, pieces get marks."""
        names, sizes_of = pieces.to_pylist(), pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for low in range(0, len(names), AT_ONCE):
            groups = [(at, min(at + 4000, low + AT_ONCE, len(names))) for at in range(low, min(low + AT_ONCE, len(names)), 4000)]
            coded = self.tokenizer.encode_batch_fast([self.joint.join(names[a:b]) for a, b in groups], add_special_tokens=False)
            for (a, b), e in zip(groups, coded, strict=True):
                ids = np.array(e.ids, np.int32)
                ends = self._ends(ids, sizes_of[a:b])
                own = self._joined(pieces[a:b]) if ends is None else (ids, np.diff(ends, prepend=-1))
                parts.append(own[0])
                sizes.append(own[1])
        return np.concatenate(parts), np.concatenate(sizes)

    def _ends(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray | None:
        """Places of each piece's last id, or None if they can't be told; ``size``
        are the pieces' bytes.

        A tokenizer that drops white space and has tokens of its own for the ends
        of words (``closing``) takes pieces of letters.  A word never spans two
        pieces and each has one at least; so where words are not as many as pieces,
        a letter was no letter any more in lower case or normal form.  A tokenizer
        of bytes (``width``) takes pieces that begin with a space, before which it
        cuts; each byte is in one token, so every piece's end is one of a token.
        """
        if len(self.closing):
            ends = np.flatnonzero(self.closing[ids])
            return ends if len(ends) == len(size) and ends[-1] == len(ids) - 1 else None
        have, want = np.cumsum(self.width[ids]), np.cumsum(size)
        if not len(ids) or have[-1] != want[-1]:
            return None
        ends = np.searchsorted(have, want)
        return ends if np.array_equal(have[ends], want) else None

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``plain``, for distinct pieces; those of earlier slices are
        remembered.  When there are too many, only those that came again stay."""
        place = pc.index_in(pieces, value_set=self.known).to_numpy(zero_copy_only=False)
        new = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(pieces), bool)
        fresh = pieces.filter(pa.array(new))
        flat, count = self._encoded(fresh)
        old = place[~new].astype(np.int64)
        self.again[old] = True
        index = np.empty(len(pieces), np.int64)
        index[~new], index[new] = old, len(self.count) + np.arange(len(fresh))
        every, size = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])
        start = np.cumsum(size) - size
        out = _gather(every, start[index], size[index]), size[index]
        self.known = pa.concat_arrays([self.known, fresh])
        self.flat, self.count, self.again = every, size, np.concatenate([self.again, np.zeros(len(fresh), bool)])
        if len(size) > REMEMBERED or self.known.nbytes > REMEMBERED_BYTES:
            keep = np.flatnonzero(self.again)
            if self.known.take(pa.array(keep)).nbytes > REMEMBERED_BYTES // 2:
                keep = keep[:0]
            self.known = self.known.take(pa.array(keep))
            self.flat, self.count = _gather(every, start[keep], size[keep]), size[keep]
            self.again = np.zeros(len(keep), bool)
        return out

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``plain``, for distinct pieces."""
        if len(self.mark_ids) != 1 or len(pieces) < 100:
            return self.plain(pieces.to_pylist())
        fits = pc.match_substring_regex(pieces, f"^ ?{_VISIBLE}$").to_numpy(zero_copy_only=False)
        alone = pc.match_substring_regex(pieces, self.alone).to_numpy(zero_copy_only=False) & (self.alone != "")
        groups = [(alone, self._unmarked), (fits & ~alone, self._joined), (~fits & ~alone, lambda x: self.plain(x.to_pylist()))]
        size, place = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        flat, before = [], 0
        for chosen, method in groups:
            ids, n = method(pieces.filter(pa.array(chosen)))
            assert len(n) == chosen.sum(), "a mark was not kept apart"
            size[chosen], place[chosen] = n, before + np.cumsum(n) - n
            flat.append(ids)
            before += len(ids)
        return _gather(np.concatenate(flat), place, size), size

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each encoded by itself, and their numbers."""
        parts = [_ragged([e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]) for at in range(0, len(texts), AT_ONCE)]
        return np.concatenate([x for x, _ in parts] or [np.zeros(0, np.int32)]), np.concatenate([n for _, n in parts] or [np.zeros(0, np.int64)])

    def _pieces(self, names: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, each after a space where ``spaced``."""
        stem = pc.utf8_rtrim(names, characters=_TAIL)
        # letters that neither lower case nor normal form end in a mark
        last = pc.match_substring_regex(stem, "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0410-\u044f]$")
        cut = pc.and_(last, pc.not_equal(pc.binary_length(stem), pc.binary_length(names)))
        stem = pc.if_else(cut, stem, names)
        where = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        tails = _after(names.take(pa.array(where)), stem.take(pa.array(where))).dictionary_encode()
        space = pc.if_else(pa.array(spaced), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
        stem = pc.binary_join_element_wise(space, stem, pa.scalar("", pa.large_string()))
        coded = stem.dictionary_encode()
        flat, count = self._distinct(pa.concat_arrays([coded.dictionary, tails.dictionary]))
        place = np.cumsum(count) - count
        first = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        second = np.full(len(names), -1, np.int64)
        second[where] = len(coded.dictionary) + tails.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.column_stack([first, second]).ravel()
        order = order[order >= 0]
        total = count[first]
        total[where] += count[second[where]]
        return _gather(flat, place[order], count[order]), total

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the texts' offsets (one more)."""
        odd = np.flatnonzero(pc.match_substring_regex(pa.array(texts, pa.large_string()), _RUNS).to_numpy(zero_copy_only=False)).tolist()
        even = list(texts)
        for i in odd:
            even[i] = ""
        split = pc.split_pattern(pc.replace_substring(pa.array(even, pa.large_string()), "\n", " \n "), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        line_end = index == pc.index(coded.dictionary, pa.scalar("\n", pa.large_string())).as_py()
        bare = line_end.copy()  # no space before a line end, behind one, at a text's beginning
        bare[1:] |= line_end[:-1]
        bare[bounds[:-1]] = True
        index[bare] += len(coded.dictionary)
        found = np.zeros(2 * len(coded.dictionary), bool)
        found[index] = True
        used, index = np.flatnonzero(found), (np.cumsum(found) - 1)[index]
        spaced = used < len(coded.dictionary)
        flat, count = self._pieces(coded.dictionary.take(pa.array(np.where(spaced, used, used - len(coded.dictionary)))), spaced)
        more, size = self.plain([texts[i] for i in odd])
        flat = np.concatenate([flat, more, [self.end]]).astype(np.int32)
        count = np.concatenate([count, size, [1]])
        for k, i in enumerate(odd):
            index[bounds[i]] = len(used) + k
        index = np.insert(index, bounds[1:], len(count) - 1)
        bounds = bounds + np.arange(len(bounds))
        size = count[index]
        place = np.cumsum(count) - count
        offsets = np.concatenate(([0], np.cumsum(size)))[bounds]
        return _gather(flat, place[index], size), offsets


def encoder(path: str, end: int) -> Encoder:
    """The encoder of this process, with what it remembers."""
    return resident(("encoder", path, end), lambda: Encoder(path, end))
