"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where that is unset, a session
    that is one process (``local[...]``, as in tests) gets a temporary folder of
    this machine; a cluster must name a folder, so there it is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="stocktake-"))
    return _own_dir[0]


class Workspace:
    """Tables that cut lineage: written to the shared folder and read again, so
    a lost executor costs a reread and not a recomputation.  What no later step
    reads is dropped on the way; results may be read until the driver ends, and
    are dropped then."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._leave)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str, fmt: str = "parquet", by: tuple[str, ...] = (), **options: str) -> DataFrame:
        """Write and read ``df``; ``by`` names columns whose values are folders."""
        path = self.path(table)
        writer = df.write.format(fmt).options(**options)
        (writer.partitionBy(*by) if by else writer).save(path)
        return self.spark.read.schema(df.schema).format(fmt).load(path)

    def drop(self, *tables: str) -> None:
        """Remove tables that no later step reads (all of them without names)."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for target in [self.path(t) for t in tables] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(target)
            path.getFileSystem(conf).delete(path, True)

    def _leave(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            if self.spark.sparkContext._jsc is not None:
                self.drop()
