"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters.

One row of a file is a document: its id, its ids as ``array<int>`` (ORC encodes
them by run length, version 2), its number in the part and the ids before it in
the part.  Parts are ranges of doc_id in ascending order and rows inside a part
ascend, so a reader of stripes has the order from metadata alone; row indexes
and a Bloom filter on doc_id let a point lookup skip stripes and row groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, over_batches, text_slices
from .tokens import encoder

#: bytes of text encoded at once: more than packing takes, as nothing else
#: stands in these tasks' memory and larger slices repeat fewer words
ENCODE_BYTES = 3_000_000
#: writer settings of the file format
ORC_OPTIONS = {
    "orc.compress": "ZSTD",
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
_ROW = "doc_id long, part int, number long, start_in_part long, n_tokens int, ids array<int>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("start_in_part", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])


def encode_parts(docs: DataFrame, tokenizer: str, end: int, parts: int | None = None) -> DataFrame:
    """Rows of the files, sorted, one Spark partition for each part.

    ``docs`` has doc_id, text and any other columns.  Null texts are empty: one
    id, the end.  Rows with the same doc_id are ordered by a hash of the text;
    they may span parts, so one id that a third of the rows share is no hot
    part.  Null doc_ids come first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = encoder(tokenizer, end)
        number, before = 0, 0
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(1), ENCODE_BYTES):
                ids, offsets = own.encode(texts)
                size = np.diff(offsets)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield batch_of(_SCHEMA, batch.column(0).slice(lo, hi - lo), np.full(hi - lo, part, np.int32), number + np.arange(hi - lo), before + offsets[:-1], size.astype(np.int32), lists)
                number, before = number + hi - lo, before + int(offsets[-1])

    return over_batches(dealt, run, _ROW)


def write_orc(docs: DataFrame, path: str, tokenizer: str, end: int, parts: int | None = None) -> None:
    """Write the ids of ``docs`` (as ``encode_parts`` takes them) to ORC files
    under ``path``, one file for each part.  Null texts are empty and have the end
    id alone, null doc_ids stand first, repeated rows are written each, texts of
    any length are whole; an empty table gives files without rows."""
    encode_parts(docs, tokenizer, end, parts).write.format("orc").options(**ORC_OPTIONS).save(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files with ``start``: ids of all documents before each.

    Only the sums of the parts are joined to the rows: one short row for each
    part, so broadcast size follows the number of files.  Rows with null or equal
    doc_ids each have their own ``start``; files without rows give none.
    """
    files = spark.read.schema(_ROW).orc(path)
    sums = files.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("size"))
    base = sums.select("part", "size").orderBy("part").collect()
    total, rows = 0, []
    for row in base:
        rows.append((row.part, total))
        total += row["size"]
    bases = spark.createDataFrame(rows, "part int, base long")
    return files.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """Documents with this id, several if the id is repeated: the predicate
    reaches the ORC reader, which skips stripes by their statistics and row groups
    by their Bloom filters.  Rows without an id are never found."""
    return spark.read.schema(_ROW).orc(path).where(F.col("doc_id") == doc_id)


def digest_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ids`` replaced by ``ids_crc32``: crc32 of the ids as
    unsigned 32-bit little-endian numbers."""
    names = [c for c in rows.columns if c != "ids"]
    fields = [pa.field("doc_id", pa.int64()), pa.field("start", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_crc32", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).view(np.uint8))
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield batch_of(schema, batch.column(0), batch.column(1), batch.column(2), crc)

    assert names == ["doc_id", "start", "n_tokens"], names
    return over_batches(rows.select(*names, "ids"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
