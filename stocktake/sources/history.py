"""The history of runs: snapshots in a folder for each run, and an index of
which repositories each run holds.

``data/run_id=X`` holds the rows of a run and ``index/run_id=X`` one row for each
of its repositories.  The index is written last, so a run without one never
happened: readers take the run folders that they need from the index, and read
no other.  A run that is written again replaces itself.

With ``sketch`` columns a run also keeps ``sketch/run_id=X``: one row for each
repository and range of hash values, a bitmap of the hashes of its keys.  A key
whose bits a run's bitmaps don't hold is not in that run, so ``novel_keys`` reads
only runs that may hold one of its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: runs of a repository that count
CAP = 200
#: bits of one bitmap (fixed by the function), bitmaps of a repository and run, and hashes of a key
BITS, BUCKETS, HASHES = 32_768, 64, 2
_INDEX = "repo string, n long, run_id string"
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


def append_run(snapshot: DataFrame, path: str, run_id: str, cap: int = CAP, sketch: Sequence[str] = ()) -> None:
    """Add a run's snapshot (repo, any other columns).  ``run_id`` sorts by time,
    as UTC stamps do; see ``append_runs``."""
    append_runs(snapshot.withColumn("run_id", F.lit(run_id)), path, cap, sketch)


def _write(rows: DataFrame, path: str) -> None:
    """Replace the run folders that ``rows`` name."""
    rows.hint("rebalance", "run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def append_runs(snapshots: DataFrame, path: str, cap: int = CAP, sketch: Sequence[str] = ()) -> None:
    """Add runs, named by ``run_id``: their rows, the sketch of the key columns
    ``sketch`` if any, and last their index.  Then run folders that no repository has among its last ``cap`` runs
    are removed, index first.  Runs of an empty table don't exist."""
    spark = snapshots.sparkSession
    _write(snapshots, f"{path}/data")
    if sketch:
        bits = hashed(snapshots, sketch).groupBy("repo", "run_id", "hash_no", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        _write(bits, f"{path}/sketch")
    # one row for each repository and run: bounded by the repositories
    counted = snapshots.groupBy("repo", F.col("run_id").cast("string").alias("run_id")).agg(F.count("*").alias("n"))
    _write(counted.select("repo", "n", "run_id"), f"{path}/index")
    if cap > 0:
        index = read_index(spark, path)
        kept = _aged(index).where(F.col("age") <= cap).select("run_id").distinct()
        # as many rows as there are run folders to remove
        for row in index.select("run_id").distinct().join(kept, "run_id", "left_anti").collect():
            for part in ("index", "sketch", "data"):
                _delete(spark, f"{path}/{part}/run_id={row.run_id}")


def _delete(spark: SparkSession, folder: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(repo, n, run_id) of all runs; empty before the first one."""
    try:
        return spark.read.schema(_INDEX).parquet(f"{path}/index")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _INDEX)


def _aged(index: DataFrame) -> DataFrame:
    """The index with ``age``, 1 for a repository's last run."""
    return index.withColumn("age", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("run_id"))))


def read_runs(spark: SparkSession, path: str, cap: int = CAP, schema: str | None = None) -> DataFrame:
    """The last ``cap`` runs of each repository, all for 0.

    Only run folders that the index names are listed and read: as many names as
    folders reach the driver, which has to list them anyway."""
    kept = _aged(read_index(spark, path)).where(F.lit(cap <= 0) | (F.col("age") <= cap)).select("repo", "run_id")
    names = sorted(r.run_id for r in kept.select("run_id").distinct().collect())
    reader = spark.read.option("basePath", f"{path}/data")
    if not names:
        return spark.createDataFrame([], schema or "repo string, run_id string")
    rows = (reader.schema(schema) if schema else reader).parquet(*[f"{path}/data/run_id={n}" for n in names])
    return rows.withColumn("run_id", F.col("run_id").cast("string")).join(kept, ["repo", "run_id"], "left_semi")


def hashed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``hash_no``, ``bucket`` and ``bit``: a row for each of
    ``HASHES`` independent hashes of the keys."""
    at = F.pmod(F.xxhash64(*keys, F.col("hash_no")), F.lit(BUCKETS * BITS)).alias("at")
    every = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1))).alias("hash_no")).select("*", at)
    # numbers of bitmaps and bits begin with 1 and 0
    return every.select("*", F.bitmap_bucket_number(F.col("at") + 1).alias("bucket"), F.bitmap_bit_position(F.col("at") + 1).alias("bit")).drop("at")


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def may_hold(spark: SparkSession, path: str, current: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """(keys, repo, run_id) of the last ``window`` runs whose sketches hold all
    bits of a key of ``current`` (repo among its keys): all runs that hold it, and
    by chance a few more."""
    kept = _aged(read_index(spark, path)).where(F.col("age") <= window).select("repo", "run_id")
    sketches = spark.read.schema("repo string, hash_no int, bucket long, bits binary, run_id string").parquet(f"{path}/sketch").join(kept, ["repo", "run_id"], "left_semi")
    asked = hashed(current.select(*keys).distinct(), keys)
    met = asked.join(sketches, ["repo", "hash_no", "bucket"]).where(_is_set(F.col("bits"), F.col("bit")))
    return met.groupBy(*keys, "run_id").agg(F.count("*").alias("n")).where(F.col("n") == HASHES).drop("n")


def novel_keys(spark: SparkSession, path: str, current: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """Rows of ``current`` whose ``keys`` (repo among them) none of the last
    ``window`` runs holds, exactly.

    The sketches say which runs may hold which key; only those runs are read, and
    only their keys, to see whether they do.  As many run names reach the driver
    as folders are read."""
    hits = may_hold(spark, path, current, keys, window)
    names = sorted(r.run_id for r in hits.select("run_id").distinct().collect())
    if not names:
        return current
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/run_id={n}" for n in names])
    held = rows.select(*keys, F.col("run_id").cast("string").alias("run_id")).join(hits, [*keys, "run_id"], "left_semi")
    return current.join(held.select(*keys), list(keys), "left_anti")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last run of each repository."""
    return read_runs(spark, path, 1)


def last_runs(runs: DataFrame, limit: int = 0) -> DataFrame:
    """Rows of the last ``limit`` runs of each repository; all for 0."""
    if limit <= 0:
        return runs
    ids = runs.select("repo", "run_id").distinct()
    age = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("run_id")))
    kept = ids.withColumn("_age", age).where(F.col("_age") <= limit).drop("_age")
    return runs.join(kept, ["repo", "run_id"], "left_semi")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that ``write_documents`` wrote, as (repo, document struct).  A
    document is one text of its line: it may be as long as a value can be, where
    the reader would take longer ones than 20 million characters for no JSON."""
    rows = spark.read.schema("repo string, document string, slug string").options(**_ANY_LENGTH).json(path)
    return rows.select("repo", F.from_json("document", schema, _ANY_LENGTH).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON line for each repository, in folders by repository."""
    documents.withColumn("slug", F.replace("repo", F.lit("/"), F.lit("__"))).write.mode("overwrite").partitionBy("slug").json(path)
