"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fewer


def _is_forest(table: DataFrame) -> bool:
    """Whether each u of (u, v) stands in one row and is no other row's v."""
    sides = table.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(table.select("v", F.lit(0), F.lit(1)))
    nodes = sides.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count(F.when(F.col("up") + F.col("down") * F.sign("up") > 1, 1))).first()[0] == 0


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root the least node of
    its component.

    Rows are (u, v), v < u.  Each round is two aggregations and two joins; a hub
    is pre-aggregated by the map side and split by the skew join.  No component
    is ever gathered.  Rounds end when the rows are stars around least nodes,
    which is looked up after each round and before the first.
    Self-loops are ignored; an empty table gives an empty result.
    """
    rows, step = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), 0
    while True:
        table = work.save(fewer(rows), f"{name}-{step}")
        if step:
            work.drop(f"{name}-{step - 1}")
        if _is_forest(table):
            return table.select(F.col("u").alias("node"), F.col("v").alias("root"))
        step += 1
        # large star: u goes to the least neighbour of v, or to v if that is less
        least = table.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        large = table.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        # small star: all that u goes to, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rows = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
