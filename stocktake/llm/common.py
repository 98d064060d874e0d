"""Helpers shared by the operators: work tables in the shared folder, batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stocktake.sources.work import Workspace, shared_dir

__all__ = ["Workspace", "batch_of", "fewer", "held_out", "over_batches", "resident", "shared_dir", "slices", "text_ranges", "text_slices", "texts_of", "tidy"]

#: bytes of text that one numpy step handles; bounds a task's memory
SLICE_CHARS = 300_000
#: bytes of one Arrow batch
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: tasks that write a table of a few numbers a row: as many as a session's
#: shuffles have partitions, or these and one for each ``SHARED`` partitions
WRITERS, SHARED = 48, 8

_resident: dict[object, object] = {}


def over_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` whose batches hold about ``BATCH_BYTES``
    at most (one long row may hold more), unless the session sets a limit of its
    own; with Spark's limit by rows alone, a task's memory would grow with the
    length of texts."""
    conf = rows.sparkSession.conf
    if conf.get(_LIMIT, None) is None:
        conf.set(_LIMIT, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def fewer(rows: DataFrame) -> DataFrame:
    """``rows``, each of a few numbers, in fewer partitions, for a table that is
    written: where shuffles have hundreds of partitions, starting a writer for
    each would take longer than the rows.  Tasks still grow in number with the
    partitions."""
    return rows.coalesce(max(WRITERS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SHARED))


def tidy(key: object = None) -> None:
    """At the start of a task: drop the model that an earlier operator's tasks
    left in this worker process, unless it is ``key``'s, and give freed memory
    back.  Workers serve many stages, so what each leaves would add up."""
    if key not in _resident:
        _resident.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def resident[T](key: object, build: Callable[[], T]) -> T:
    """The one model that a worker process keeps between tasks."""
    tidy(key)
    if key not in _resident:
        _resident[key] = build()
    return _resident[key]


def held_out(doc_id: Column | str) -> Column:
    """True for the third of documents that no model may learn from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def text_ranges(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``limit`` bytes each."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = int(np.searchsorted(ends, ends[lo] - size[lo] + limit)) + 1
        yield lo, min(hi, len(size))
        lo = hi


def text_slices(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """As ``text_ranges``, with the texts; only one range at a time stands in
    memory as Python strings."""
    for lo, hi in text_ranges(column, limit):
        yield lo, hi, texts_of(column.slice(lo, hi - lo))


def slices(texts: Sequence[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``limit`` characters each."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def batch_of(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
