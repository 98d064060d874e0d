"""Not-modified revisits of web archives, resolved to full responses.

A revisit record says that a server answered "not modified".  Its content is
that of the latest full response for the same canonical URL that was captured
earlier: an as-of join.  Validators are checked (entity tag first, else the
modification time), and the headers that a not-modified answer may update are
merged over those of the response.

The as-of join works on moments: one row for each canonical URL and time, with
the answer that stands there.  So records that repeat, or share a moment, are
combined before any window sees them.  The moments of a URL that holds a
thousandth of all moments or more are dealt to buckets by rank, at quantiles of
its own times, so that no outlier in time fills one bucket; the first window looks back
inside a bucket, the second carries the last answer of each bucket to later
ones.  Every revisit then meets its moment by an equality join.  Bodies take no
part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: fixed values: headers that a not-modified answer may update
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified"]
#: buckets of a hot URL; URLs with fewer moments than these are never hot, and
#: those with so many always are
BUCKETS, HOT, ALWAYS = 64, 1000, 1_000_000
_TRACKING = "(utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme-less host without ``www.``, ``m.`` or a default port,
    the path without a last slash, the query without tracking parameters,
    no fragment.  Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^(www|m)[.]|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    query = F.regexp_replace(query, f"(^|&){_TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def merge_headers(response: Column, revisit: Column) -> Column:
    """Headers of the response, permitted ones replaced by the revisit's."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    new = F.map_filter(F.coalesce(revisit, empty), lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    old = F.map_filter(F.coalesce(response, empty), lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(old, new)


def _bucketed(moments: DataFrame, buckets: int, hot: int, work: Workspace | None = None) -> tuple[DataFrame, bool]:
    """``moments`` with ``bucket``, and whether any URL has more than one.  A URL
    is cut at quantiles of its times if it has ``hot`` moments and a thousandth of
    all, or ``ALWAYS`` moments whatever share that is.  The bounds are a table of those URLs, joined like any other:
    Spark sends it where it is small, and splits the skewed side where not."""
    work = work or Workspace(moments.sparkSession, "warc")
    least = min(ALWAYS, max(hot, moments.count() // 1000))
    large = moments.groupBy("canonical").count().where(F.col("count") >= least).select("canonical")
    at = [k / buckets for k in range(1, buckets)]
    bounds = moments.join(large, "canonical", "left_semi").groupBy("canonical").agg(F.array_sort(F.array_distinct(F.percentile_approx(F.col("captured").cast("double"), at, 10_000))).alias("bounds"))
    bounds = work.save(bounds, "bounds")
    if bounds.isEmpty():
        return moments.withColumn("bucket", F.lit(0)), False
    rank = F.size(F.filter("bounds", lambda b: b < F.col("captured").cast("double")))
    return moments.join(bounds, "canonical", "left").withColumn("bucket", F.when(F.col("bounds").isNull(), 0).otherwise(rank)).drop("bounds"), True


def resolve_revisits(records: DataFrame, buckets: int = BUCKETS, hot: int = HOT) -> DataFrame:
    """Revisits of ``records`` with what they resolve to.

    ``records``: ``record_id`` string; ``url``; ``captured`` timestamp or number;
    ``kind`` (``response`` or ``revisit``; others are ignored); ``headers`` map
    of lower-case names; any other columns.  Result, one row for each revisit
    row: ``record_id``, ``canonical``, ``captured``, ``response_id`` (null: none
    earlier), ``status`` (``resolved``, ``validator-mismatch``, ``no-validator``
    or ``no-response``) and ``headers``, merged if resolved.

    Strictly earlier counts; responses captured at the same time go by
    record_id, the greatest last, then by their headers as text.  Repeated
    revisit rows give as many result rows, repeated responses count once.  Null
    urls and null times resolve to nothing.  A response that fails the
    validators is not replaced by an older one.  An empty table gives no row.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("canonical"), F.col("captured").alias("captured"), "kind", "headers")
    work = Workspace(records.sparkSession, "warc")
    answer = F.struct("record_id", "headers")
    full = F.col("kind") == "response"
    order = F.when(full, F.struct(F.coalesce("record_id", F.lit("")), F.coalesce(F.to_json("headers"), F.lit(""))))
    moments = rows.where("canonical IS NOT NULL AND captured IS NOT NULL").groupBy("canonical", "captured").agg(F.max_by(F.when(full, answer), order).alias("answer"))
    # saved, as its rows are counted, cut at quantiles and then read
    moments, several = _bucketed(work.save(moments, "moments"), buckets, hot, work)
    near = Window.partitionBy("canonical", "bucket").orderBy("captured").rowsBetween(Window.unboundedPreceding, -1)
    found = moments.withColumn("found", F.last("answer", True).over(near))
    if several:
        # the last answer of every bucket, and of those before it
        tops = moments.groupBy("canonical", "bucket").agg(F.max_by(F.when(F.col("answer").isNotNull(), F.col("answer")), F.when(F.col("answer").isNotNull(), F.col("captured"))).alias("top"))
        far = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = tops.withColumn("far", F.last("top", True).over(far)).where("bucket > 0 AND far IS NOT NULL").select("canonical", "bucket", "far")
        found = found.join(carried, ["canonical", "bucket"], "left").withColumn("found", F.coalesce("found", "far"))
    found = found.where("found IS NOT NULL").select("canonical", "captured", F.col("found.record_id").alias("response_id"), F.col("found.headers").alias("_stored"), F.lit(True).alias("_met"))
    asked = rows.where("kind = 'revisit'")
    # rows without a url or a time meet nothing: they would all be one key of the join
    placed = asked.where("canonical IS NOT NULL AND captured IS NOT NULL").join(found, ["canonical", "captured"], "left")
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("response_id", "_stored", "_met")]
    rows = placed.unionByName(asked.where("canonical IS NULL OR captured IS NULL").select("*", *none))
    tag, stored_tag = F.col("headers")["etag"], F.col("_stored")["etag"]
    time, stored_time = F.col("headers")["last-modified"], F.col("_stored")["last-modified"]
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    status = (
        F.when(F.col("_met").isNull(), "no-response")
        .when(tag.isNotNull() & stored_tag.isNotNull(), F.when(weak(tag) == weak(stored_tag), "resolved").otherwise("validator-mismatch"))
        .when(time.isNotNull() & stored_time.isNotNull(), F.when(time == stored_time, "resolved").otherwise("validator-mismatch"))
        .otherwise("no-validator")
    )
    rows = rows.withColumn("status", status)
    merged = F.when(F.col("status") == "resolved", merge_headers(F.col("_stored"), F.col("headers")))
    return rows.select("record_id", "canonical", "captured", "response_id", "status", merged.alias("headers"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Records of a crawl over ``pages`` (page_id, url, html, any other columns):
    each page is a full response at ten times its id, with the hash of its html as
    entity tag, and was asked for again fifteen moments later by its entity tag.
    Null ids give null moments and null record ids, null urls null urls, null html
    the tag ``"none"`` and length 0; repeated rows give repeated records; an empty
    table gives none."""
    tag = F.concat(F.lit('"'), F.coalesce(F.md5("html"), F.lit("none")), F.lit('"'))
    text = lambda c: c.cast("string")
    moment = F.col("page_id") * 10
    full = pages.select(
        F.concat(F.lit("r"), text(F.col("page_id"))).alias("record_id"), "url", moment.alias("captured"), F.lit("response").alias("kind"),
        F.create_map(F.lit("etag"), tag, F.lit("date"), text(moment), F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.coalesce(F.length("html"), F.lit(0)))).alias("headers"),
    )
    again = pages.select(
        F.concat(F.lit("v"), text(F.col("page_id"))).alias("record_id"), "url", (moment + 15).alias("captured"), F.lit("revisit").alias("kind"),
        F.create_map(F.lit("etag"), tag, F.lit("date"), text(moment + 15), F.lit("content-type"), F.lit("text/plain")).alias("headers"),
    )
    return full.unionByName(again)
