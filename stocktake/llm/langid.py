"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every string
that occurs in that text.  A document is parsed, left to right, into the longest
phrases that the automaton knows; the language whose automaton needs the fewest
phrases, normalised by the logarithm of its text's length, wins.

The automata are tables of next states: one entry for each state and letter of
the language while such tables are small, and else only the steps that exist, the
rows of all states laid into each other's gaps.  All segments of a slice of
documents walk them in step, so one numpy operation advances thousands of
documents by a letter; a failed step returns to the root and counts a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, held_out, over_batches, resident, text_slices

#: bound of the training sample: passages of each language, and characters of one
PASSAGES_PER_LANG = 40
PASSAGE = 2_000
#: entries of full tables in one worker, over all languages; those of further
#: languages, and wide ones, are sparse
FULL_ENTRIES = 32_000_000
#: bits a letter above which no learned language explains a text; text of a
#: learned language needs a third to a half of it, short texts up to eight
STRANGE = 9.0
#: phrases that are forgiven, as in a few letters any phrase is short
FORGIVEN = 2
#: letters of a segment; each segment starts at the root
SEGMENT = 512


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def normalise(text: str) -> str:
    """Lower-case letters, each run of anything else one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def training_text(docs: DataFrame, passages: int = PASSAGES_PER_LANG) -> dict[str, str]:
    """A bounded sample of labelled text per language: ``passages`` passages of
    the learnable two thirds, in the order of a hash of their document and place.

    All labelled texts are cut into passages, so any part of a text may be
    chosen.  A first pass counts the passages of each language; a second keeps
    those whose hash is small enough that about four times as many as needed
    stay, so the ranking reads that many rows at any size of ``docs``.
    """
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang", "text")
    parts = F.ceil(F.length("text") / PASSAGE)
    counts = learn.groupBy("lang").agg(F.sum(parts).alias("n")).where("n > 0").collect()  # a row for each language
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 4 * passages / r.n))])
    place = learn.where("text <> ''").select("*", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("i"))
    mark = F.xxhash64("doc_id", "i")
    few = place.where((mark / float(1 << 64) + 0.5) <= F.try_element_at(share, "lang"))
    few = few.select("lang", mark.alias("mark"), F.substring("text", F.col("i") * PASSAGE + 1, F.lit(PASSAGE)).alias("part"))
    few = few.distinct()  # repeated rows have one mark: they count once, and don't fill a task
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "part"))
    found = few.withColumn("rank", rank).where(F.col("rank") <= passages).collect()
    out: dict[str, list[str]] = {}
    for row in sorted(found, key=lambda x: (x.lang, x["rank"])):
        out.setdefault(row.lang, []).append(normalise(row.part))
    return {lang: " " + " ".join(x for x in own if x) + " " for lang, own in sorted(out.items()) if any(own)}


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the least automaton of all substrings of ``text``."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return step


class Full:
    """An automaton as one table.  An entry holds the place of the next row and,
    in its lowest bit, whether a phrase ended."""

    def __init__(self, automaton: list[dict[str, int]], column: dict[str, int]) -> None:
        width = len(column) + 1  # the last column: letters that the language never had
        row = 2 * width
        root = np.full(width, len(automaton) * row, np.int32)
        root[[column[c] for c in automaton[0]]] = [to * row for to in automaton[0].values()]
        table = np.empty((len(automaton) + 1, width), np.int32)
        table[:] = root + 1  # a failed step ends a phrase
        table[0] = root
        for state, arrows in enumerate(automaton):
            for c, to in arrows.items():
                table[state, column[c]] = to * row
        self.table = table.ravel()

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next places, and whether a phrase ended."""
        value = self.table[state + letter]
        return value >> 1, value & 1


class Sparse:
    """An automaton by its existing steps.  Those of a state stand at the state's
    base plus the letter; ``owner`` tells whose step a place holds."""

    def __init__(self, automaton: list[dict[str, int]], column: dict[str, int]) -> None:
        width, n = len(column) + 1, len(automaton)
        self.root = np.full(width, n, np.int32)
        self.root[[column[c] for c in automaton[0]]] = list(automaton[0].values())
        steps = sum(map(len, automaton))
        size = steps + 2 * width
        taken, self.base = bytearray(size), np.zeros(n + 1, np.int32)
        places, owners, targets = [], [], []
        low = reached = width  # no gap before the first
        # wide rows first; narrow ones fill the gaps
        for state in sorted(range(1, n), key=lambda s: -len(automaton[s])):
            letters = [column[c] for c in automaton[state]]
            if not letters:
                continue
            # a wide row is not tried in gaps far behind, which narrow ones will fill
            least, at = min(letters), low if len(letters) == 1 else max(low, reached)
            while True:
                at = taken.find(0, at)
                if at < 0:
                    at = len(taken)
                if at + width >= len(taken):
                    taken.extend(bytes(len(taken) // 2 + width))
                base = at - least
                if base >= 0 and not any(taken[base + x] for x in letters):
                    break
                at += 1
            reached = max(reached, at - 4 * width)
            for x, to in zip(letters, automaton[state].values(), strict=True):
                taken[base + x] = 1
                places.append(base + x)
                owners.append(state)
                targets.append(to)
            self.base[state] = base
            low = taken.find(0, low)
            low = len(taken) if low < 0 else low
        last = max(places, default=0) + width + 1
        self.owner, self.target = np.full(last, -1, np.int32), np.zeros(last, np.int32)
        self.owner[places], self.target[places] = owners, targets

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.base[state] + letter
        found = self.owner[place] == state
        return np.where(found, self.target[place], self.root[letter]), ~found & (state != 0)


class CrossParser:
    """The automata of several languages.  A letter that a language never had is
    a phrase by itself: it leads to the last state, which has no step."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = list(texts)
        alphabet = sorted(set("".join(texts.values())) - {" "})
        self.symbol = np.full(0x110000, len(alphabet) + 1, np.uint16 if len(alphabet) < 0xFFFE else np.uint32)  # letters never learned
        self.symbol[~_letters()] = 0
        self.symbol[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.tables: list[Full | Sparse] = []
        self.column: list[np.ndarray] = []  # of each symbol, in a language's table
        self.cost, room = [], FULL_ENTRIES
        for text in texts.values():
            own = sorted(set(text) - {" "})
            column = {" ": 0} | {c: i + 1 for i, c in enumerate(own)}
            at = np.full(len(alphabet) + 2, len(column), np.int32)
            at[0] = 0
            at[[self.symbol[ord(c)] for c in own]] = np.arange(1, len(column))
            automaton = suffix_automaton(text)
            entries = (len(automaton) + 1) * (len(column) + 1)
            full = entries <= min(room, FULL_ENTRIES // 4)
            room -= entries if full else 0
            self.tables.append((Full if full else Sparse)(automaton, column))
            self.column.append(at)
            self.cost.append(np.log2(max(2, len(text))))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases for each text and language; letters for each text."""
        lowered = [t.lower() for t in texts]
        joined = "\n".join(lowered) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol[codes]
        ends = np.cumsum([len(t) + 1 for t in lowered]) - 1
        space = symbols == 0
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        keep[ends] = True  # at least one symbol a text
        count = np.add.reduceat(keep.astype(np.int64), np.concatenate(([0], ends[:-1] + 1)))
        letters = np.add.reduceat((~space).astype(np.int64), np.concatenate(([0], ends[:-1] + 1)))
        stream = symbols[keep]
        begins = np.concatenate(([0], np.cumsum(count)))
        parts = -(-count // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = begins[owner] + number * SEGMENT
        size = np.minimum(SEGMENT, begins[owner + 1] - start)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        grid = np.zeros((SEGMENT, len(owner)), self.symbol.dtype)  # what lies behind a segment's end is not read
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t, side="left"))
            grid[t, :live] = stream[start[:live] + t]
        total = np.zeros((len(texts), len(self.langs)))
        for k, (table, column) in enumerate(zip(self.tables, self.column, strict=True)):
            state = np.zeros(len(owner), np.int32)
            found = np.zeros(len(owner), np.int32)
            for t in range(int(size.max(initial=0))):
                live = int(np.searchsorted(-size, -t, side="left"))
                state[:live], ended = table.step(state[:live], column[grid[t, :live]])
                found[:live] += ended
            total[:, k] = np.bincount(owner, found + 1, len(texts))  # the open phrase counts
        return total, letters


def _parser(texts: tuple[tuple[str, str], ...]) -> CrossParser:
    """One parser for each worker process; it is built from the few kilobytes
    of training text, which is cheaper than sending its tables."""
    return resident(("cross-parser", hash(texts)), lambda: CrossParser(dict(texts)))


def identify(docs: DataFrame, training: dict[str, str]) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of each row of ``docs``
    (doc_id, text, any other columns, which predictions don't see).

    A text that is null, empty or has no letter (digits, marks, emojis) is
    ``und`` with score 0, as is any text if nothing was learned.  Texts are parsed
    whole, however long; repeated rows and null ids are rows like others; an empty
    table gives no row.  Score: 1/2 if two languages tie, nearer 1 the
    fewer phrases the best needs against the second; 1 with one language
    learned.  Ties go to the language that sorts first.
    """
    texts = tuple(training.items())
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(texts)
        for batch in batches:
            for lo, hi, part in text_slices(batch.column(2)):
                if not texts:
                    lang, score = ["und"] * len(part), np.zeros(len(part))
                else:
                    found, letters = parser.phrases(part)
                    cost = found * np.array(parser.cost)
                    best = cost.argmin(axis=1)
                    lang = [parser.langs[b] if n else "und" for b, n in zip(best, letters, strict=True)]
                    ranked = np.sort(cost, axis=1)
                    score = ranked[:, 1] / (ranked[:, 0] + ranked[:, 1]) if cost.shape[1] > 1 else np.ones(len(part))
                    score = np.where(letters > 0, score, 0.0)
                yield batch_of(schema, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lang, score)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return over_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, training: dict[str, str]) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, any other columns), all columns, whose
    text is in a learned language.

    Dropped are texts without a letter (null and empty ones, too), and those
    for which even the best language needs more than ``STRANGE`` bits a letter:
    phrases, less ``FORGIVEN``, times the logarithm of the language's text, by
    the letters of the document.  Texts of other scripts and random letters need that much.  If
    nothing was learned, only texts without a letter are dropped.  Repeated rows
    and null ids are rows like others; rows stay in place, nothing is shuffled;
    an empty table stays empty.
    """
    texts = tuple(training.items())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(texts)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, part in text_slices(batch.column(at)):
                found, letters = parser.phrases(part)
                keep[lo:hi] = letters > 0
                if texts:
                    keep[lo:hi] &= ((found - FORGIVEN) * np.array(parser.cost)).min(axis=1) <= STRANGE * np.maximum(letters, 1)
            yield batch.filter(pa.array(keep))

    return over_batches(docs, run, docs.schema)
