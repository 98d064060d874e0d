"""Runs of repeated words: stretches of a text that repeat with a period.

A run is a stretch of words with smallest period q that is at least ``LENGTH``
words and ``EXPONENT`` periods long and that no neighbouring word extends.  A
run's root is a Lyndon word under the order of words or under its reverse, and
it is the longest Lyndon word that starts at its place.  So for both orders the
longest Lyndon words are found by a stack scanned from right to left, and each
of them is extended to both sides by its length.

Suffixes are compared, and roots extended, by the longest common extension of
two places: a binary search over rolling hashes, whose answer is then checked
word by word.  What was checked for a distance is remembered, so the words of a
stretch are checked once.

Any three words in a row of a run occur in it at least ``TIMES`` times.  Numpy
drops all stretches without that first, over a whole slice of documents, so only
what may hold a run is scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, text_ranges, tidy
from .textnum import mix

#: periods and words that a run has at least
EXPONENT, LENGTH = 4, 6
#: words in a row, and how often each such row occurs in a run at least: a run of
#: period 1 has LENGTH - 2 places for it, one of period q > 1 has 4q - 2, of which
#: every q-th holds the same
GRAM, TIMES = 3, 3
_PRIME = (1 << 61) - 1
_BASE = 1_000_003_579
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: bytes that stand between words
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

Run = tuple[int, int, int]


class Extensions:
    """Longest common extensions within one list of word numbers."""

    def __init__(self, words: np.ndarray) -> None:
        self.array = np.ascontiguousarray(words)
        self.words = self.array.tolist()
        total, power = 0, 1
        self.sums, self.powers = [0], [1]
        for w in self.words:
            total = (total * _BASE + w + 1) % _PRIME
            power = power * _BASE % _PRIME
            self.sums.append(total)
            self.powers.append(power)
        #: for a distance, the last stretch known to equal the words so far behind it
        self.known: dict[int, tuple[int, int]] = {}

    def _hash(self, at: int, size: int) -> int:
        return (self.sums[at + size] - self.sums[at] * self.powers[size]) % _PRIME

    def _most(self, limit: int, equal) -> int:
        """The greatest size up to ``limit`` for which ``equal`` holds, as it
        does for all smaller ones."""
        low, step = 0, 1
        while low + step <= limit and equal(low + step):
            low += step
            step *= 2
        high = min(limit, low + step - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if equal(middle):
                low = middle
            else:
                high = middle - 1
        return low

    def forward(self, i: int, j: int) -> int:
        """Words that the suffixes from ``i`` < ``j`` share at their beginning."""
        size = self._most(len(self.words) - j, lambda k: self._hash(i, k) == self._hash(j, k))
        differ = np.flatnonzero(self.array[i : i + size] != self.array[j : j + size])
        if not len(differ):
            return size
        return int(differ[0])  # two hashes of different words agreed

    def backward(self, i: int, j: int) -> int:
        """Words that the prefixes up to ``i`` < ``j`` share at their end."""
        size = self._most(i, lambda k: self._hash(i - k, k) == self._hash(j - k, k))
        differ = np.flatnonzero(self.array[i - size : i] != self.array[j - size : j])
        if not len(differ):
            return size
        return size - 1 - int(differ[-1])

    def stretch(self, at: int, gap: int) -> tuple[int, int]:
        """The longest range around ``at`` of which each word equals that
        ``gap`` places behind it; the word at ``at`` does."""
        low, high = self.known.get(gap, (0, 0))
        if not low <= at < high:
            low, high = at - self.backward(at, at + gap), at + self.forward(at, at + gap)
            self.known[gap] = low, high
        return low, high

    def lyndon_ends(self, reverse: bool) -> Iterator[tuple[int, int]]:
        """(start, end) of the longest Lyndon word from every place, from right
        to left; its end is the next place whose suffix is smaller.  A suffix
        that begins another one is smaller in both orders."""
        words, n = self.words, len(self.words)
        ends = [n] * n
        for i in range(n - 1, -1, -1):
            own, j = words[i], i + 1
            while j < n:
                if own == words[j]:
                    size = self.stretch(i, j - i)[1] - i
                    if j + size == n or (words[i + size] < words[j + size]) == reverse:
                        break
                elif (own < words[j]) == reverse:
                    break
                j = ends[j]
            ends[i] = j
            yield i, j

    def runs(self) -> list[Run]:
        """(start, length, period) of all runs, by start, then period."""
        found: set[Run] = set()
        for reverse in (False, True):
            for i, j in self.lyndon_ends(reverse):
                if j < len(self.words) and self.words[i] == self.words[j]:
                    low, high = self.stretch(i, j - i)
                    length = high + j - i - low
                    if length >= max(LENGTH, EXPONENT * (j - i)):
                        found.add((low, length, j - i))
        return sorted(found, key=lambda r: (r[0], r[2]))


def may_repeat(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of word numbers, each within one text, that hold all runs; text
    ``i`` is ``bounds[i]:bounds[i + 1]``."""
    starts, ends = bounds[:-1], bounds[1:]
    while True:
        long = ends - starts >= LENGTH
        starts, ends = starts[long], ends[long]
        size = ends - starts - GRAM + 1
        owner = np.repeat(np.arange(len(starts)), size)
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) - first[owner] + starts[owner]
        gram = owner.astype(np.uint64)
        for k in range(GRAM):
            gram = gram * _STEP + words[at + k].astype(np.uint64)
        order = np.argsort(mix(gram))  # different rows of words with one number can only add places
        ordered = gram[order]
        new = np.append(np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])), len(order)) if len(order) else np.zeros(1, np.int64)
        often = np.zeros(len(order) + 1, bool)
        often[order] = np.repeat(np.diff(new) >= TIMES, np.diff(new))
        # stretches of places that occur often, cut where a text ends
        inner = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)
        opens = often[:-1] & ~np.append(False, (often[:-1] & inner)[:-1])[: len(owner)]
        closes = often[:-1] & ~(inner & often[1:])
        lo, hi = at[opens], at[closes] + GRAM
        if len(lo) == len(starts) and (hi - lo).sum() == (ends - starts).sum():
            return list(zip(lo.tolist(), hi.tolist(), strict=True))
        starts, ends = lo, hi


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, and each text's place among them (one more)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    table = np.ones(256, bool)
    table[list(SEPARATORS)] = False
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    kept = np.concatenate(([0], np.cumsum(inside)))
    values = data[inside].tobytes()
    places = np.append(kept[starts], len(values)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(values))
    return words, np.searchsorted(starts, offsets)


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.large_string())])


def runs_of(words: np.ndarray, bounds: np.ndarray) -> list[list[Run]]:
    """Runs of each text, its words numbered from 0."""
    out: list[list[Run]] = [[] for _ in bounds[1:]]
    for lo, hi in may_repeat(words, bounds):
        text = int(np.searchsorted(bounds, lo, side="right")) - 1
        shift = lo - int(bounds[text])
        out[text] += [(start + shift, length, period) for start, length, period in Extensions(words[lo:hi]).runs()]
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in out]


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period, by start, then
    period) and ``collapsed`` of each row of ``docs`` (doc_id, text, any other
    columns): the text's words joined by one space, without those that a run
    holds behind its first period.

    Words are what ``SEPARATORS`` leave.  Null and empty texts have no word, no
    run and an empty collapsed text.  Texts are searched whole, however long;
    repeated rows give repeated results, null ids stay null, an empty table
    gives no row.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for lo, hi in text_ranges(batch.column(1)):
                words, bounds = split_words(batch.column(1).slice(lo, hi - lo))
                numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                found = runs_of(numbers, bounds)
                keep = np.ones(len(words) + 1, bool)
                for base, own in zip(bounds.tolist(), found, strict=False):
                    for start, length, period in own:
                        keep[base + start + period : base + start + length] = False
                keep[-1] = False
                left = np.concatenate(([0], np.cumsum(keep[:-1])))[bounds]
                lists = pa.LargeListArray.from_arrays(pa.array(left), words.filter(pa.array(keep[:-1])))
                collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
                size = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
                items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN))
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), runs, collapsed], schema=_SCHEMA)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_batches(rows, run, RUNS)


def digest_runs(found: DataFrame) -> DataFrame:
    """``found`` in short: the number of runs, the longest one (ties: the
    smallest start, then period; nulls without a run), and hashes of all runs
    and of the collapsed text."""
    ranked = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.withColumn("best", ranked)
    length, period = F.col("best.length"), -F.col("best.period")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
