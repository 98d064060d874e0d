"""Sum-of-squares online packing of documents into training windows.

A window has 4,096 places.  Full windows are cut from long documents first.
What remains, an item, goes to a fill level: with N(h) windows filled to h, the
item goes where the sum of N(h)^2 after it is least, a new window being level
0.  The level array holds N(h), one stack of windows for each level.

When a task's rows end, or its open windows hold ``OPEN_TOKENS``, they are
closed: the emptiest are cut up to fill the fullest, documents being free to
continue in another window.  The last one becomes sequences whose lengths are
powers of two, which need no padding.  So each task packs its own partition of
the scan, nothing is shuffled, and no padding is left.  The more documents a task
has, the more windows the rule itself fills: about six in ten with a thousand
documents, nine in ten with eight thousand; closing fills the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, over_batches, text_slices
from .tokens import ENCODE_CHARS, encoder

WINDOW = 4096
#: tokens that a task keeps in open windows
OPEN_TOKENS = 2_000_000
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.large_binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_length", pa.int64())])
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long"

#: (document, start, ids, tokens of the document)
Piece = tuple[int | None, int, np.ndarray, int]


class SumOfSquares:
    """The level array of one task."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.levels: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.open_tokens = 0
        self.full: list[list[Piece]] = []

    def place(self, piece: Piece) -> None:
        """Put an item of 1 to ``window`` ids where the squares grow least."""
        size = len(piece[2])
        if size == self.window:
            self.full.append([piece])
            return
        top = self.window - size
        # moving a window from h to h + size changes the sum of squares by
        # 2 (N(h + size) - N(h)) + 2; level 0 and a full window count nothing
        change = 2 * (self.count[size : self.window] - self.count[:top]) + 2
        change[0] = 2 * self.count[size] + 1
        best, level = int(change[1:].min(initial=1 << 60)), 0
        if top > 1:
            open_levels = self.count[1:top] > 0
            best = 1 << 60
            if open_levels.any():
                at = np.where(open_levels, change[1:], 1 << 60)
                level = int(at.argmin()) + 1
                best = int(at[level - 1])
        if self.count[top] and top > 0 and -2 * self.count[top] + 1 <= best:
            best, level = int(-2 * self.count[top] + 1), top  # fills a window
        if level == 0 or int(change[0]) < best:
            window: list[Piece] = []
            level = 0
        else:
            window = self.levels[level].pop()
            self.count[level] -= 1
        window.append(piece)
        if level + size == self.window:
            self.full.append(window)
            self.open_tokens -= level
        else:
            self.levels[level + size].append(window)
            self.count[level + size] += 1
            self.open_tokens += size

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            self.full.append([(doc_id, at, ids[at : at + self.window], len(ids))])
        if whole < len(ids):  # a copy, as a view would keep the slice's ids alive
            self.place((doc_id, whole, ids[whole:].copy(), len(ids)))

    def close(self) -> list[list[Piece]]:
        """All windows so far, the open ones filled up from each other."""
        waiting = [(h, w) for h in range(1, self.window) for w in self.levels[h]]
        low, high = 0, len(waiting) - 1
        spare: list[Piece] = []
        while low <= high:
            level, window = waiting[high]
            high -= 1
            while level < self.window:
                if not spare:
                    if low > high:
                        break
                    spare = waiting[low][1][::-1]
                    low += 1
                doc, start, ids, total = spare.pop()
                room = self.window - level
                window.append((doc, start, ids[:room], total))
                level += min(room, len(ids))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], total))
            self.full.append(window)
        rest = spare[::-1]
        if self.full and sum(len(p[2]) for p in self.full[-1]) < self.window:
            rest = self.full.pop() + rest
        left = sum(len(p[2]) for p in rest)
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            sequence, have = [], 0
            while have < size:
                doc, start, ids, total = rest[0]
                cut = min(size - have, len(ids))
                sequence.append((doc, start, ids[:cut], total))
                have += cut
                rest = ([(doc, start + cut, ids[cut:], total)] if cut < len(ids) else []) + rest[1:]
            self.full.append(sequence)
            left -= size
        out, self.full = self.full, []
        self.count[:] = 0
        self.levels = [[] for _ in range(self.window)]
        self.open_tokens = 0
        return out


def pack(docs: DataFrame, tokenizer: str, end: int, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in their sequences.

    ``docs`` has doc_id, text and any other columns; null texts are empty and
    have one id, the end.  Result: ``doc_id``; ``start``, ids of the document
    before the piece; ``length``; ``ids``, unsigned 32-bit little-endian;
    ``doc_tokens``; ``sequence_id``, unique: the
    number of the task and the number in it; ``offset`` in the sequence;
    ``padded_length`` of the sequence, equal to the sum of its pieces.  Ties,
    repeated rows and null ids are packed like any others; an empty table gives
    no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(tokenizer, end), SumOfSquares(window)
        number = TaskContext.get().partitionId() << 40

        def flush(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in _SCHEMA]
            for sequence in sequences:
                offset, size = 0, sum(len(p[2]) for p in sequence)
                for doc, start, ids, total in sequence:
                    for column, value in zip(out, (doc, start, len(ids), ids.astype("<u4").tobytes(), total, number, offset, size), strict=True):
                        column.append(value)
                    offset += len(ids)
                number += 1
            return batch_of(_SCHEMA, *out)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, texts in text_slices(batch.column(1), ENCODE_CHARS):
                ids, offsets = own.encode(texts)
                for i in range(hi - lo):
                    packer.add(names[lo + i], ids[offsets[i] : offsets[i + 1]])
                if packer.open_tokens > OPEN_TOKENS:
                    yield flush(packer.close())
                done, packer.full = packer.full, []
                for at in range(0, len(done), 1000):
                    yield flush(done[at : at + 1000])
        rest = packer.close()
        for at in range(0, len(rest), 1000):
            yield flush(rest[at : at + 1000])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_batches(rows, run, PIECES)


def digest_pieces(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``ids`` replaced by ``ids_crc32``.  Null doc_ids stay null,
    repeated rows stay repeated, no piece has null ids; an empty table stays empty."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def crc_of(ids: np.ndarray) -> int:
    """The crc32 that ``digest_pieces`` gives these ids."""
    return zlib.crc32(ids.astype("<u4").tobytes())
