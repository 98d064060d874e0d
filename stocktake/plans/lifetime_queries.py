"""Queries of what happens to keys over many runs, as tables and as a stream, of
the run index, and of documents checked by a schema.  A run is a day of
``events``, a repository an event type, a key a user."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.functions.schema import violations
from stocktake.operators import drift
from stocktake.operators import relational as R
from stocktake.plans.registry import Registry, registered, table
from stocktake.sources import history
from stocktake.sources.work import Workspace
from stocktake.streaming.drift import CHANGES, SNAPSHOT, follow

QUERIES: Registry = {}


def _events(spark: SparkSession, sf_dir: str, day: Column) -> DataFrame:
    key = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("repo"), F.lit("models").alias("section"), key.alias("key"), F.col("props").alias("payload"), day, "ts", "event_id")


@registered(
    QUERIES,
    """WITH r AS (SELECT event_type AS repo, strftime(ts, '%Y%m%d') AS run_id, user_id::VARCHAR AS key FROM events GROUP BY ALL),
n AS (SELECT repo, run_id, row_number() OVER (PARTITION BY repo ORDER BY run_id) AS no FROM (SELECT DISTINCT repo, run_id FROM r)),
k AS (SELECT r.repo, r.key, r.run_id, n.no, lag(n.no) OVER w AS before FROM r JOIN n USING (repo, run_id) WINDOW w AS (PARTITION BY r.repo, r.key ORDER BY n.no)),
z AS (SELECT repo, max(no) AS last_no FROM n GROUP BY repo)
SELECT k.repo, 'models' AS section, key, min(run_id) AS first_seen, max(run_id) AS last_seen, count(*)::BIGINT AS runs_seen, (count(*) FILTER (WHERE no - before > 1))::BIGINT AS absences,
  max(coalesce(no - before - 1, 0))::BIGINT AS longest_absence, CASE WHEN max(no) < max(last_no) THEN 'gone' WHEN count(*) = 1 THEN 'new' WHEN max_by(before, no) = max(no) - 1 THEN 'present' ELSE 'returned' END AS status
FROM k JOIN z ON k.repo = z.repo GROUP BY k.repo, key""",
)
def key_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last run, absences and status of every key over all runs."""
    return drift.lifetimes(_events(spark, sf_dir, F.date_format("ts", "yyyyMMdd").alias("run_id")))


_KEEP = timedelta(days=3)
_CHANGES = """WITH s AS (SELECT event_type AS repo, 'models' AS section, user_id::VARCHAR AS key, date_trunc('day', ts)::TIMESTAMP AS t, max(props) AS payload FROM events GROUP BY ALL),
w AS (SELECT *, lag(t) OVER k AS before, lag(payload) OVER k AS was, lead(t) OVER k AS next, (SELECT max(t) FROM s) AS newest FROM s WINDOW k AS (PARTITION BY repo, section, key ORDER BY t))
SELECT repo, section, key, strftime(t, '%Y-%m-%d') AS day, CASE WHEN before IS NULL OR before + INTERVAL 3 DAY < t THEN 'added' ELSE 'changed' END AS status, payload FROM w WHERE before IS NULL OR before + INTERVAL 3 DAY < t OR payload IS DISTINCT FROM was
UNION ALL SELECT repo, section, key, strftime(t + INTERVAL 3 DAY, '%Y-%m-%d'), 'removed', payload FROM w WHERE (next IS NULL OR next > t + INTERVAL 3 DAY) AND t + INTERVAL 3 DAY < newest"""


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, F.date_trunc("day", F.col("ts")).cast("timestamp").alias("at"))
    return rows.select("repo", "section", "key", "payload", "at")


def _by_day(changes: DataFrame) -> DataFrame:
    return changes.select("repo", "section", "key", F.date_format("at", "yyyy-MM-dd").alias("day"), "status", "payload")


@registered(QUERIES, _CHANGES)
def key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When keys came, changed and went, a key being kept for three days."""
    return _by_day(drift.key_changes(_sightings(spark, sf_dir), "3 DAY"))


@registered(QUERIES, _CHANGES)
def key_changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, each key with a state of its own."""
    work = Workspace(spark, "drift")
    # a snapshot holds a key once
    once = _sightings(spark, sf_dir).groupBy("repo", "section", "key", "at").agg(F.max("payload").alias("payload"))
    once.select(*[n.split(" ")[0] for n in SNAPSHOT.split(", ")]).write.parquet(work.path("in"))
    follow(spark, work.path("in"), work.path("out"), work.path("state"), _KEEP).awaitTermination()
    return _by_day(spark.read.schema(CHANGES).parquet(work.path("out")))


@registered(
    QUERIES,
    """WITH s AS (SELECT event_type AS repo, strftime(ts, '%Y%m%d') AS run_id, user_id::VARCHAR AS key, arg_max(props, (ts, event_id)) AS payload FROM events GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY run_id DESC) AS age FROM (SELECT DISTINCT repo, run_id FROM s))
SELECT s.repo, s.run_id, s.key, s.payload FROM s JOIN k USING (repo, run_id) WHERE age <= 3""",
)
def indexed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs written with their index; the last three read by it."""
    rows = _events(spark, sf_dir, F.date_format("ts", "yyyyMMdd").alias("run_id"))
    runs = R.keep_last(rows, ["repo", "run_id", "section", "key"], ["ts", "event_id"]).select("repo", "section", "key", "payload", "run_id")
    path = Workspace(spark, "history").path("runs")
    history.append_runs(runs, path, cap=5)
    return history.read_runs(spark, path, 3, runs.drop("run_id").schema.simpleString()[7:-1].replace(":", " ") + ", run_id string").select("repo", "run_id", "key", "payload")


_TWO_RUNS = """s AS (SELECT event_type AS repo, strftime(ts, '%Y%m%d') AS run_id, user_id::VARCHAR AS key, arg_max(props, (ts, event_id)) AS payload FROM events GROUP BY ALL),
r AS (SELECT repo, run_id, row_number() OVER (PARTITION BY repo ORDER BY run_id DESC) AS age FROM (SELECT DISTINCT repo, run_id FROM s)),
n AS (SELECT s.* FROM s JOIN r USING (repo, run_id) WHERE age = 1), o AS (SELECT s.* FROM s JOIN r USING (repo, run_id) WHERE age = 2),
c AS (SELECT coalesce(o.repo, n.repo) AS repo, 'models' AS section, coalesce(o.key, n.key) AS key, CASE WHEN o.repo IS NULL THEN 'added' WHEN n.repo IS NULL THEN 'removed' WHEN o.payload IS DISTINCT FROM n.payload THEN 'changed' END AS status, o.payload AS old_payload, n.payload AS new_payload FROM o FULL JOIN n ON o.repo = n.repo AND o.key = n.key)"""


def _last_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The last run of each repository, and all before it."""
    rows = _events(spark, sf_dir, F.date_format("ts", "yyyyMMdd").alias("run_id"))
    runs = R.keep_last(rows, ["repo", "run_id", "section", "key"], ["ts", "event_id"]).select(*drift.KEY, "payload", "run_id")
    marked = runs.join(runs.groupBy("repo").agg(F.max("run_id").alias("newest")), "repo")
    return marked.where("run_id = newest").select(*drift.KEY, "payload"), marked.where("run_id < newest").drop("newest")


@registered(QUERIES, f"WITH {_TWO_RUNS} SELECT * FROM c WHERE status IS NOT NULL")
def trend_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that changed from each repository's run before the last to the last."""
    return drift.trend(*_last_runs(spark, sf_dir), 3)[0]


@registered(QUERIES, f"WITH {_TWO_RUNS} SELECT repo, section, (count(*) FILTER (WHERE status = 'added'))::BIGINT AS added, (count(*) FILTER (WHERE status = 'removed'))::BIGINT AS removed, (count(*) FILTER (WHERE status = 'changed'))::BIGINT AS changed FROM c WHERE status IS NOT NULL GROUP BY ALL")
def trend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys were added, removed and changed."""
    return drift.trend(*_last_runs(spark, sf_dir), 3)[2]


_ORDER_SCHEMA = {
    "type": "object",
    "required": ["key", "status", "lines"],
    "additionalProperties": False,
    "properties": {"key": {"type": "integer", "minimum": 1}, "status": {"enum": ["O", "F", "P"]}, "priority": {"type": "string", "pattern": "^[1-5]-"}, "lines": {"type": "array", "items": {"$ref": "#/$defs/line"}}},
    "$defs": {"line": {"type": "object", "required": ["number"], "additionalProperties": False, "properties": {"number": {"type": "integer", "maximum": 7}, "flag": {"type": ["string", "null"]}}}},
}


@registered(
    QUERIES,
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 AS kind FROM orders), f(kind, pointer, message) AS (VALUES
(1, '/status', '''status'' is a required property'), (1, '/lines', '''lines'' is a required property'), (2, '/key', 'value is not of type integer'), (2, '/extra~1name', 'property is not allowed'),
(3, '/lines/0/number', 'value is greater than 7'), (3, '/lines/1/number', '''number'' is a required property'), (3, '/lines/1/no', 'property is not allowed'), (4, '/priority', 'value does not match ^[1-5]-'), (4, '/lines', 'value is not of type array'),
(5, '/', 'document is not JSON'), (6, '/status', 'value is not one of ["O", "F", "P"]'), (6, '/lines/0/flag', 'value is not of type string or null'))
SELECT k AS o_orderkey, pointer, message FROM o JOIN f USING (kind) UNION ALL SELECT k, '/key', 'value is less than 1' FROM o WHERE k < 1 AND kind NOT IN (2, 5)""",
)
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of JSON documents made from orders, six kinds of them faulty."""
    kinds = ['"status":"O","lines":[{"number":1,"flag":null}]}', '"priority":"1-URGENT"}', '"extra/name":1,"status":"F","lines":[]}', '"status":"P","lines":[{"number":8},{"no":1}]}', '"status":"O","priority":"high","lines":{}}', '"status"', '"status":"X","lines":[{"number":2,"flag":0}]}']
    key = F.when(F.col("o_orderkey") % 7 == 2, F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('"'))).otherwise(F.col("o_orderkey").cast("string"))
    rest = F.element_at(F.array(*map(F.lit, kinds)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit('{"key":'), key, F.lit(","), rest).alias("document"))
    return docs.select("o_orderkey", F.explode(violations(F.col("document"), _ORDER_SCHEMA)).alias("v")).select("o_orderkey", "v.pointer", "v.message")
