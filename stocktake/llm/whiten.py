"""Whitening of embeddings: each component gets mean 0 and variance 1, and no
two components vary together.

Entries become integers first, so counts and sums are exact.  A partition sums
its rows up to their number, their mean and their centred scatter, and two such
summaries merge by Chan's formula in a tree of tasks; only the last one reaches
the driver, as large as the square of the dimension.  The components are the
unit eigenvectors of the covariance.  A second pass sums up the whitened rows in
the same way and compares their covariance with the identity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, tidy

#: an entry c becomes floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: entries from here on have no exact integer
LARGEST = float(1 << 52)
#: summaries for each core at most: a task reads several splits before it sends one
PARTS_PER_CORE = 4
#: shares of the variance from which a component counts as one
LEAST_SHARE = 1e-12


@dataclass
class Summary:
    """Count, mean and centred scatter of some rows."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Summary:
        mean = rows.mean(axis=0)
        centred = rows - mean
        # what rounding left of the mean is taken off both
        rest = centred.mean(axis=0)
        centred -= rest
        return cls(len(rows), mean + rest, centred.T @ centred)

    def merged(self, other: Summary) -> Summary:
        """Chan's formula; the summary of both sets of rows."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        gap = other.mean - self.mean
        mean = self.mean + gap * (other.n / n)
        return Summary(n, mean, self.scatter + other.scatter + np.outer(gap, gap) * (self.n * (other.n / n)))

    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


@dataclass
class Whitening:
    """What the fit list gives: exact sums, and the components by falling
    eigenvalue, one a row."""

    n: int
    total: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = math.nan

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, which is split into its integer part and the rest so
        that neither loses digits."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.total), strict=True)
        return (x - np.array(whole, np.int64)) - np.array([r / self.n for r in rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sums of (n * x - total) squared over the dimensions, exact."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.total), strict=True)
        gap, rest = x - np.array(whole, np.int64), np.array(rest, np.int64)
        most = (int(np.abs(gap).max(initial=0)) + 1) * self.n
        if most * most * len(self.total) < 1 << 63:
            return np.square(gap * self.n - rest).sum(axis=1).tolist()
        gap, rest = gap.astype(object), rest.astype(object)
        return np.square(gap * self.n - rest).sum(axis=1).tolist()


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows with a vector of the commonest
    length (ties: the greater one) whose entries are numbers below ``LARGEST``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < LARGEST))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    lengths = rows.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    return rows.where(F.size("v") == (lengths.k if lengths else 0))


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of integers from a batch whose last column holds the vectors."""
    lists = batch.column(batch.num_columns - 1)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(flat * SCALE) + SHIFT).astype(np.int64).reshape(batch.num_rows, -1)


_PART = pa.schema([("n", pa.int64()), ("total", pa.list_(pa.string())), ("mean", pa.binary()), ("scatter", pa.binary())])


def _summed(rows: DataFrame, model: Whitening | None) -> tuple[Summary, list[int]]:
    """Summary and sums of the integers of ``rows``, or of their whitened values
    by ``model``: one summary a task, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        own, total = Summary(0, np.zeros(0), np.zeros(0)), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch)
            part = Summary.of(x.astype(np.float64) if model is None else model.project(x))
            own = own.merged(part)
            sums = x.sum(axis=0).tolist()
            total = sums if total is None else [a + b for a, b in zip(total, sums, strict=True)]
        if own.n:
            yield pa.RecordBatch.from_arrays([pa.array([own.n]), pa.array([[str(s) for s in total]]), pa.array([own.mean.tobytes()]), pa.array([own.scatter.tobytes()])], schema=_PART)

    def opened(row) -> tuple[Summary, list[int]]:
        mean = np.frombuffer(row["mean"])
        return Summary(row["n"], mean, np.frombuffer(row["scatter"]).reshape(len(mean), len(mean))), [int(s) for s in row["total"]]

    def merge(a: tuple[Summary, list[int]], b: tuple[Summary, list[int]]) -> tuple[Summary, list[int]]:
        if not a[0].n or not b[0].n:
            return a if a[0].n else b
        return a[0].merged(b[0]), [x + y for x, y in zip(a[1], b[1], strict=True)]

    parts = PARTS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    summaries = over_batches(rows.select("v").coalesce(parts), run, "n long, total array<string>, mean binary, scatter binary").rdd.map(opened)
    empty = (Summary(0, np.zeros(0), np.zeros(0)), [])
    # an empty summary in each partition, as the tree asks for at least one
    return summaries.mapPartitions(lambda own: [*own] or [empty]).treeReduce(merge, depth=max(2, math.ceil(math.log(parts, 8))))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``rows`` of ``usable``; null without rows."""
    found, total = _summed(rows, None)
    if not found.n:
        return None
    covariance = found.covariance()
    values, vectors = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    kept = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > LEAST_SHARE * trace]
    model = Whitening(found.n, total, values[kept], np.ascontiguousarray(vectors[:, kept].T), trace)
    if kept:
        again, _ = _summed(rows, model)
        model.identity_error = float(np.abs(again.covariance() - np.eye(len(kept))).max())
    return model


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, any other columns)
    and component: ``vec_id``; ``component`` from 1; ``n``, rows of the fit list;
    ``deviation``, the sum over dimensions of (n x - sum)^2; ``whitened``;
    ``explained``, the component's share of the variance; ``identity_error``,
    the largest entry of the whitened covariance less the identity.

    The fit list is all rows left.  Rows are left out whose vector is null,
    empty, not of the commonest length, or holds null, entries that are no finite
    number, or entries of 2^42 and more, which have no exact integer.  Components
    without variance, as of a single row or of equal rows, have no whitened value
    and no row.  Repeated rows count as often as they occur, null ids stay null,
    an empty table gives no row.
    """
    rows = usable(vectors)
    model = fit(rows, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], WHITENED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        k = len(model.values)
        for batch in batches:
            m = batch.num_rows
            x = _numbers(batch)
            deviation = pa.array([Decimal(d) for d in model.deviation(x)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column(0).take(each), np.tile(np.arange(1, k + 1), m), np.full(m * k, model.n), deviation.take(each), model.project(x).ravel(), np.tile(model.values / model.trace, m), np.full(m * k, model.identity_error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    return over_batches(rows, run, WHITENED)
