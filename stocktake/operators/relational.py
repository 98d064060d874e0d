"""Operators on any table: first and last rows, merges, differences, exceptions,
thresholds, coverage.

Keeping one row of a group is an aggregation (``min_by``), not a window: it
combines before the shuffle, so a key that holds a third of all rows costs each
task one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktake.functions import columns as X


def _one(df: DataFrame, keys: Sequence[str], pick: Column) -> DataFrame:
    rows = df.groupBy(*keys).agg(pick.alias("_row"))
    return rows.select("_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, by ``order``, of each distinct ``keys``; null keys are one
    group.  ``order`` must not tie, or either row may stay."""
    return _one(df, keys, F.min_by(F.struct(*df.columns), F.struct(*order)))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each distinct ``keys``: later rows replace earlier."""
    return _one(df, keys, F.max_by(F.struct(*df.columns), F.struct(*order)))


def merge_last_known(facts: DataFrame, keys: Sequence[str], part: Sequence[str], within: Sequence[str]) -> DataFrame:
    """(*keys, value): the last known value over all parts.

    Inside a part (say a file) the last value counts, an ``unknown`` one too;
    over parts, in the order of the columns ``part``, the last known value
    counts.  Both steps combine before their shuffle.
    """
    final = facts.groupBy(*keys, *part).agg(F.max_by("value", F.struct(*within)).alias("value"))
    final = final.where(X.known("value").isNotNull())
    return final.groupBy(*keys).agg(F.max_by("value", F.struct(*part)).alias("value"))


def fill_from(rows: DataFrame, context: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``rows`` whose unknown ``fields`` come from ``context``, one row for each
    ``keys``; ``unknown`` where neither knows."""
    theirs = context.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(theirs, list(keys), "left")
    filled = {f: F.coalesce(X.known(f), X.known(f"_{f}"), F.lit("unknown")) for f in fields}
    return joined.withColumns(filled).select(*rows.columns)


def difference(old: DataFrame, new: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """(*keys, status, old_*, new_*) of keys that were added, removed or changed.
    Both sides have one row a key."""
    sides = [df.select(*keys, F.struct(*payload).alias(name)) for df, name in ((old, "_old"), (new, "_new"))]
    joined = sides[0].join(sides[1], list(keys), "full_outer")
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    out = joined.withColumn("status", status).where("status IS NOT NULL")
    return out.select(*keys, "status", *[F.col(f"{side}.{p}").alias(f"{side[1:]}_{p}") for side in ("_old", "_new") for p in payload])


def change_counts(changes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Added, removed and changed keys."""
    return changes.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed")])


def novel(current: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``current`` whose keys ``history`` never held."""
    return current.join(history.select(*keys).distinct(), list(keys), "left_anti")


def top_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``.  Spark limits each
    group in every task before the shuffle, so no group is gathered whole."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def match_exceptions(entities: DataFrame, exceptions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``entities`` with ``reason``, that of the first exception, by ``pos``,
    whose fields equal theirs; a blank field matches any value.

    Each distinct choice of values asks for every choice of blank fields, so
    this is an equality join and no loop over pairs; the answers go back by the
    values themselves.
    """
    blank = F.lit("")
    value = {f: F.coalesce(F.col(f), blank) for f in fields}
    distinct = entities.select(*[v.alias(f"_{f}") for f, v in value.items()]).distinct()
    asks = [F.struct(*[(F.col(f"_{f}") if keep else blank).alias(f"_a_{f}") for f, keep in zip(fields, mask, strict=True)]) for mask in product((True, False), repeat=len(fields))]
    own = [f"_{f}" for f in fields]
    asked = distinct.select(*own, F.explode(F.array_distinct(F.array(*asks))).alias("_ask")).select(*own, "_ask.*")
    known = exceptions.select(*[F.btrim(F.coalesce(f, blank)).alias(f"_a_{f}") for f in fields], "pos", "reason")
    hits = asked.join(known, [f"_a_{f}" for f in fields]).groupBy(*own).agg(F.min_by("reason", "pos").alias("reason"))
    rows = entities.withColumns({f"_{f}": v for f, v in value.items()})
    return rows.join(hits, own, "left").drop(*own)


def coverage(groups: DataFrame, rows: DataFrame, key: str, done: Column) -> DataFrame:
    """Rows seen and done for each of ``groups``, zero where there are none."""
    counts = rows.groupBy(key).agg(F.count("*").alias("seen"), F.count_if(done).alias("scanned"))
    return groups.select(key).distinct().join(counts, key, "left").na.fill(0, ["seen", "scanned"])


def unpivot_known(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(*keys, name, value) of the fields that are not empty."""
    return df.unpivot(list(keys), list(fields), "name", "value").where("coalesce(value, '') <> ''")


def first_distinct(df: DataFrame, keys: Sequence[str], value: str, n: int = 10) -> DataFrame:
    """(*keys, listed): the first ``n`` distinct values of each group, joined by
    commas.  Groups are cut to ``n`` values before they are gathered."""
    rows = df.select(*keys, F.col(value).alias("_v")).where("_v IS NOT NULL").distinct()
    few = top_of_each(rows, keys, [F.col("_v")], n)
    return few.groupBy(*keys).agg(F.concat_ws(", ", F.sort_array(F.collect_list("_v"))).alias("listed"))
