"""Source trees as tables of files.

Spark's file sources skip names that begin with a dot or underscore, and
``.env`` is an input here, so local trees are walked by tasks.  A tree is listed
level by level: the folders of a level are dealt out, tasks list them and write
what they find, and the folders among that are the next level.  So one wide or
deep folder of one repository keeps all tasks busy, and the driver sees no name.
Files are then dealt out anew, into as many tasks as the listed bytes need.

What can't be read is a row that says why: a repository without its root, a
folder without permission, a file that is too large.  Trees in a store that only
Spark reads come from ``files_of``, which takes any table of (repo, rel_path,
content).
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake import constants as C
from stocktake.functions import columns as X
from stocktake.sources.work import Workspace

LISTING = "repo string, root string, rel_path string, kind string, bytes long, error string"
_LISTED = pa.schema([("repo", pa.string()), ("root", pa.string()), ("rel_path", pa.string()), ("kind", pa.string()), ("bytes", pa.int64()), ("error", pa.string())])
_CONTENT = pa.schema([("repo", pa.string()), ("rel_path", pa.string()), ("content", pa.large_binary())])
#: entries of a folder that one batch holds
ENTRIES = 10_000
#: listed bytes and files that one task reads, about
PART_BYTES, PART_FILES = 128 << 20, 50_000
#: bytes of the largest file that is read, and of one batch of contents
MAX_BYTES, BATCH_BYTES = 1 << 30, 8 << 20


@dataclass
class Trees:
    """Files that can be read (repo, root, rel_path, bytes), and what can't
    (repo, rel_path, error), an empty path being the root."""

    files: DataFrame
    errors: DataFrame


def entries(repo: str, root: str, folder: str, max_bytes: int = MAX_BYTES) -> Iterator[tuple]:
    """Rows of ``LISTING`` for what a folder of a tree holds.  Links to folders
    are not followed; below folders that no scan enters only notebooks count."""

    def row(rel_path: str, kind: str, size: int | None = None, error: str | None = None) -> tuple:
        return repo, root, rel_path, kind, size, error

    reason = lambda e: e.strerror or type(e).__name__
    skipped = bool(set(folder.split("/")) & set(C.IGNORED_DIRS))
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for entry in found:
                rel = f"{folder}/{entry.name}" if folder else entry.name
                try:
                    if entry.is_dir(follow_symlinks=False):
                        yield row(rel, "folder")
                    elif entry.is_file() and (not (skipped or entry.name in C.IGNORED_DIRS) or rel.endswith(".ipynb")):
                        size = entry.stat().st_size
                        if not os.access(entry.path, os.R_OK):
                            yield row(rel, "error", size, os.strerror(13))
                        elif size > max_bytes:
                            yield row(rel, "error", size, f"larger than {max_bytes} bytes")
                        else:
                            yield row(rel, "file", size)
                except OSError as e:
                    yield row(rel, "error", None, reason(e))
    except OSError as e:
        yield row(folder, "error", None, reason(e))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ENTRIES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _LISTED, strict=True)], schema=_LISTED)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _LISTED, strict=True)], schema=_LISTED)


def list_trees(roots: DataFrame, max_bytes: int = MAX_BYTES) -> Trees:
    """All that the trees of ``roots`` (repo, root: a folder that executors see)
    hold.  One job for each level of folders; what it lists is written, so a lost
    executor repeats its own folders only.  A repository named twice is listed
    twice; a null root is an error; an empty table lists nothing."""
    spark = roots.sparkSession
    work = Workspace(spark, "trees")
    tasks = spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, root, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _batches(iter([(repo, root, "", "error", None, "no root")]) if root is None else entries(repo, root, folder, max_bytes))

    folders = roots.select("repo", "root", F.lit("").alias("rel_path"))
    levels: list[DataFrame] = []
    while True:
        # a number of its own, as the rows are too short for sizes to tell the work
        dealt = folders.repartition(tasks, "repo", "rel_path")
        levels.append(work.save(dealt.mapInArrow(run, LISTING), f"level-{len(levels)}"))
        folders = levels[-1].where("kind = 'folder'").select("repo", "root", "rel_path")
        if folders.isEmpty():
            break
    listed = reduce(DataFrame.unionAll, levels)
    return Trees(listed.where("kind = 'file'").select("repo", "root", "rel_path", "bytes"), listed.where("kind = 'error'").select("repo", "rel_path", "error"))


def contents(files: DataFrame) -> DataFrame:
    """(repo, rel_path, content) of listed ``files``, in tasks of about
    ``PART_BYTES``.  A file that went away since has null content."""
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    parts = max(1, -(-total["size"] // PART_BYTES), -(-total["n"] // PART_FILES))
    parts = max(parts, min(total["n"], files.sparkSession.sparkContext.defaultParallelism), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for repo, root, rel in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with open(os.path.join(root, rel), "rb") as f:
                        rows.append((repo, rel, f.read()))
                except OSError:
                    rows.append((repo, rel, None))
                size += len(rows[-1][2] or b"") + 100
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CONTENT, strict=True)], schema=_CONTENT)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CONTENT, strict=True)], schema=_CONTENT)

    return files.select("repo", "root", "rel_path").repartition(parts, "repo", "rel_path").mapInArrow(run, "repo string, rel_path string, content binary")


def write_trees(files: DataFrame, folder: str) -> None:
    """Write (repo, rel_path, content) as source trees, one folder for each
    repository, below a folder that executors see.  A file is written beside its
    place and then moved there, so a task that runs twice leaves one whole file.
    Null contents are empty files; of rows with one path any may stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = f".{TaskContext.get().taskAttemptId()}.part"
        for batch in batches:
            for repo, rel, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = os.path.join(folder, repo, rel)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path + mark, "wb") as f:
                    f.write(content or b"")
                os.replace(path + mark, path)
        yield from ()

    files.select("repo", "rel_path", "content").mapInArrow(run, "repo string").write.format("noop").mode("overwrite").save()


def files_of(contents: DataFrame) -> DataFrame:
    """(repo, rel_path, name, suffix, text) from (repo, rel_path, content).
    ``text`` is null where the bytes are no UTF-8; of ignored folders only
    notebooks are kept."""
    files = contents.where(~X.is_ignored("rel_path") | (X.suffix("rel_path") == ".ipynb"))
    return files.select("repo", "rel_path", X.file_name("rel_path").alias("name"), X.suffix("rel_path").alias("suffix"), X.decoded("content").alias("text"))


def read_trees(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    """Files of local source trees, by repository name; what can't be read is
    left out (``list_trees`` tells)."""
    return files_of(contents(list_trees(spark.createDataFrame([*roots.items()], "repo string, root string")).files))


def repo_list(spark: SparkSession, path: str, first: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Distinct repositories (repo, place) of a list file behind those named
    first, the first ``limit`` of them; blank lines and comments are skipped, the
    first mention counts."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(X.lines("value")).alias("place", "repo"))
    given = spark.createDataFrame([(i - len(first), x) for i, x in enumerate(first)], "place int, repo string")
    rows = given.unionByName(text).select("place", F.btrim("repo").alias("repo")).where("repo <> '' AND NOT startswith(repo, '#')")
    found = rows.groupBy("repo").agg(F.min("place").alias("place"))
    return found if limit is None else found.orderBy("place").limit(limit)


def license_report(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(name, license, verdict) of a report: a JSON list of packages, or with
    ``lines`` one package a line, which Spark splits."""
    rows = spark.read.schema("Name string, License string").option("multiLine", str(not lines).lower()).json(path)
    return rows.select(F.col("Name").alias("name"), F.col("License").alias("license"), X.license_verdict(F.col("License")).alias("verdict"))
