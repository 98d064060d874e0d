"""Token counts of whole texts; huge ones are encoded in overlapping chunks.

A tokenizer file first takes out its special strings, then cuts what is between
them into words, from left to right, and last encodes each word by itself.  How
the rest of a text is cut depends on the place of a cut and on what follows it,
looking a few characters ahead and never back.  So

* a word that starts in a chunk that begins at a true cut, and starts at least
  ``margin`` characters before the chunk's end, starts in the whole text, too;
* if the next chunk, begun anywhere before, has a word start at the same place,
  both cut alike from there on.

Such a place is a proven boundary: tokens before it are counted in the one chunk,
tokens from it on in the other.  If an overlap holds none, it is widened to twice
its width; one that would reach back to the last proven boundary starts there and
needs none.

Short texts without special strings repeat most of their words, so each distinct
word of a batch is encoded once (``tokens``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, over_batches, resident, text_slices
from .tokens import Encoder

#: characters of a text that is encoded at once, and of a chunk of a longer one
CHUNK = 32_768
#: characters that two chunks share at first
OVERLAP = 256
#: bytes of short texts encoded at once
AT_ONCE = 1_200_000
#: characters that a cut may depend on: those of special strings, or this many
AHEAD = 16


class Counter:
    """Counts by one tokenizer file, special strings being handled as its
    library does by default."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.encoder = Encoder(path, 0)
        self.tokenizer = self.encoder.tokenizer
        self.tokenizer.encode_special_tokens = False
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.margin = max([AHEAD, *map(len, self.special)]) + 1
        self.chunk, self.overlap = chunk, min(overlap, chunk // 2)
        #: overlaps that held no proven boundary so far
        self.widened = 0

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        long = np.array([len(t) > self.chunk for t in texts], bool)
        odd = np.array([any(x in t for x in self.special) for t in texts], bool) & ~long
        for i in np.flatnonzero(long):
            out[i] = self.spliced(texts[i])
        for i, e in zip(np.flatnonzero(odd), self.tokenizer.encode_batch_fast([texts[i] for i in np.flatnonzero(odd)], add_special_tokens=False), strict=True):
            out[i] = len(e)
        rest = np.flatnonzero(~long & ~odd)
        if len(rest):
            _, offsets = self.encoder.encode([texts[i] for i in rest])
            out[rest] = np.diff(offsets) - 1  # the encoder appends one
        return out.tolist()

    def _cuts(self, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places in ``text`` where words of a chunk start, the tokens of the
        chunk before each, and all its tokens."""
        e = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        words = np.array(e.word_ids, np.int64)
        first = np.flatnonzero(np.diff(words, prepend=-1))
        offsets = e.offsets
        return begin + np.array([offsets[k][0] for k in first], np.int64), first, len(words)

    def spliced(self, text: str) -> int:
        """Tokens of a text, from overlapping chunks."""
        total = taken = 0  # tokens before the last proven boundary; those of its chunk
        proven, end = 0, min(self.chunk, len(text))
        cuts, tokens, size = self._cuts(text, 0, end)
        while end < len(text):
            width, after = self.overlap, min(len(text), end + self.chunk - self.overlap)
            while True:
                begin = max(proven, end - width)
                new_cuts, new_tokens, new_size = self._cuts(text, begin, after)
                if begin == proven:
                    cuts, tokens, size, taken = new_cuts, new_tokens, new_size, 0
                    break
                both, mine, its = np.intersect1d(cuts, new_cuts, return_indices=True)
                both = np.searchsorted(both, end - self.margin, side="right") - 1, both
                if both[0] >= 0 and both[1][both[0]] > begin:
                    k = both[0]
                    total += int(tokens[mine[k]]) - taken
                    proven, taken = int(both[1][k]), int(new_tokens[its[k]])
                    cuts, tokens, size = new_cuts, new_tokens, new_size
                    break
                self.widened += 1
                width *= 2
            end = after
        return total + size - taken


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than
    ``limit``) of each row of ``docs`` (doc_id, text, any other columns).

    Null and empty texts have no token.  Nothing is truncated: texts of more
    than ``chunk`` characters are encoded in chunks, which also bounds a task's
    memory beside the text itself.  Repeated rows give repeated results, null
    ids stay null, an empty table gives no row.  Nothing is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident(("counter", tokenizer, chunk, overlap), lambda: Counter(tokenizer, chunk, overlap))
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(2), AT_ONCE):
                n = np.array(counter.count(texts), np.int64)
                yield batch_of(schema, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), n, n > limit)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return over_batches(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
