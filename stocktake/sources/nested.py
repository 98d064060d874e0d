"""Nested documents written in order: one JSON file for each repository, streamed.

Rows of a repository come to one task, sorted by section and key, and the task
writes them one after another, so a repository of any size takes the memory of
one row: the sort spills, the file is a stream.  Tasks write beside the target;
only when all of them are done the files are moved to their places, and a job that
fails leaves none.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

ROWS = "repo string, section string, key string, item string"
_UNSAFE = re.compile(r"[^A-Za-z0-9._-]")


def file_name(repo: str) -> str:
    """Of a repository's file: what is no safe letter is its code in hexadecimal,
    so different repositories have different files."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):x}", repo) + ".json"


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote beside the target."""

    names: list[str] = field(default_factory=list)
    folder: str = ""


class _Writer(DataSourceWriter):
    def __init__(self, path: str, sections: Sequence[str], job: str) -> None:
        self.path, self.sections, self.job = path.rstrip("/"), list(sections), job

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self._place()
        task = TaskContext.get()
        done = Written(folder=f"{root}/_writing-{self.job}/{task.partitionId()}-{task.taskAttemptId()}")
        out, repo, at, first = None, None, 0, True

        def start(section: int) -> None:
            """Write empty sections up to this one and begin it."""
            nonlocal at, first
            while at <= section:
                out.write(f"{'' if at == 0 else '],'}\n{_quoted(self.sections[at])}:[".encode())
                at, first = at + 1, True

        def finish() -> None:
            if out is not None:
                start(len(self.sections) - 1)
                out.write(b"]\n}\n")
                out.close()

        number = {s: i for i, s in enumerate(self.sections)}
        for row in iterator:
            if row["repo"] != repo or out is None:
                finish()
                repo, at, first = row["repo"], 0, True
                if not done.names:
                    store.create_dir(done.folder, recursive=True)
                done.names.append(file_name(repo))
                out = store.open_output_stream(f"{done.folder}/{done.names[-1]}")
                out.write(b"{")
            if row["section"] is not None:
                start(number[row["section"]])
                out.write(f"{'' if first else ','}\n{row['item']}".encode())
                first = False
        finish()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._place()
        for message in messages:
            for name in message.names if message else []:
                store.move(f"{message.folder}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = self._place()
        if store.get_file_info(f"{root}/_writing-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_writing-{self.job}")


def _quoted(name: str) -> str:
    import json

    return json.dumps(name)


class NestedDocuments(DataSource):
    """``df.write.format("nested_documents").option("sections", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "nested_documents"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["sections"].split("\n"), self.options["job"])


def write_nested(rows: DataFrame, path: str, sections: Sequence[str], repos: DataFrame | None = None) -> None:
    """Write ``rows`` (repo, section, key, item: JSON) as one file for each
    repository below ``path``, a folder that driver and executors share.

    A file is an object of ``sections``, in this order, each a list of its items
    by key, then text.  Sections without rows are empty lists, and so are all of a
    repository that only ``repos`` names.  Sections that are not listed are an
    error.  Files of earlier writes stay unless they are written again; a null
    repository has no file."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(NestedDocuments)
    place = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    known = rows.where("repo IS NOT NULL").select("repo", "section", "key", "item", F.when(F.col("section").isNull() | (place == 0), F.raise_error(F.concat(F.lit("no such section: "), F.coalesce("section", F.lit("null"))))).otherwise(place).cast("int").alias("place"))
    if repos is not None:
        none = [F.lit(None).cast("string").alias(c) for c in ("section", "key", "item")]
        known = known.unionByName(repos.where("repo IS NOT NULL").select("repo", *none, F.lit(0).alias("place")).distinct())
    dealt = known.repartition("repo").sortWithinPartitions("repo", "place", "key", "item")
    dealt.select("repo", "section", "key", "item").write.format("nested_documents").mode("append").options(path=path, sections="\n".join(sections), job=uuid.uuid4().hex).save()


def section_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """``ROWS`` of tables that begin with ``repo``: each row an item with sorted
    keys, its own text the key."""
    from functools import reduce

    parts = []
    for name, table in tables.items():
        item = F.to_json(F.struct(*sorted(c for c in table.columns if c != "repo")))
        parts.append(table.select("repo", F.lit(name).alias("section"), item.alias("key"), item.alias("item")))
    return reduce(DataFrame.unionByName, parts)
