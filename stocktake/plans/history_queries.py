"""Queries of merges, differences, gates, exceptions and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.operators import drift, export, inventory, report, risk
from stocktake.operators import relational as R
from stocktake.plans.registry import Registry, registered, table
from stocktake.plans.source_queries import _TOOLED, tool_files
from stocktake.sources.history import last_runs

QUERIES: Registry = {}

_FACTS = "f AS (SELECT user_id, event_type, event_id, ts, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE props END AS value FROM events)"
_MERGED = "one AS (SELECT user_id, event_type, day, arg_max(value, (ts, event_id)) AS value FROM f GROUP BY ALL), merged AS (SELECT user_id, event_type, arg_max(value, day) AS value FROM one WHERE value <> 'unknown' GROUP BY ALL)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 5 == 0, "unknown").otherwise(F.col("props"))
    return events.select("user_id", "event_type", "event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), value.alias("value"))


@registered(QUERIES, f"WITH {_FACTS}, {_MERGED} SELECT * FROM merged")
def merge_last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_last_known(_facts(spark, sf_dir), ["user_id", "event_type"], ["day"], ["ts", "event_id"])


@registered(
    QUERIES,
    f"""WITH {_FACTS}, {_MERGED} SELECT f.event_id, CASE WHEN f.event_id % 3 = 0 AND f.value <> 'unknown' THEN f.value ELSE coalesce(m.value, 'unknown') END AS value
FROM f LEFT JOIN merged m ON f.user_id = m.user_id AND f.event_type = m.event_type""",
)
def context_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    context = R.merge_last_known(facts, ["user_id", "event_type"], ["day"], ["ts", "event_id"])
    rows = facts.withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise("unknown"))
    return R.fill_from(rows, context, ["user_id", "event_type"], ["value"]).select("event_id", "value")


_SNAPSHOTS = "s AS (SELECT event_id % 2 AS run, event_type AS repo, CASE WHEN event_type IN ('purchase', 'view') THEN 'models' ELSE 'tools' END AS section, user_id::VARCHAR AS key, arg_max(props, (ts, event_id)) AS payload FROM events GROUP BY ALL), o AS (SELECT * FROM s WHERE run = 0), n AS (SELECT * FROM s WHERE run = 1), c AS (SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.section, n.section) AS section, coalesce(o.key, n.key) AS key, CASE WHEN o.repo IS NULL THEN 'added' WHEN n.repo IS NULL THEN 'removed' WHEN o.payload IS DISTINCT FROM n.payload THEN 'changed' END AS status, o.payload AS old_payload, n.payload AS new_payload FROM o FULL JOIN n ON o.repo = n.repo AND o.section = n.section AND o.key = n.key)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    section = F.when(F.col("event_type").isin("purchase", "view"), "models").otherwise("tools")
    rows = events.select(F.col("event_type").alias("repo"), section.alias("section"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"), "ts", "event_id")
    runs = [R.keep_last(rows.where(F.col("event_id") % 2 == k), drift.KEY, ["ts", "event_id"]) for k in (0, 1)]
    return drift.compare(*runs)


@registered(QUERIES, f"WITH {_SNAPSHOTS} SELECT * FROM c WHERE status IS NOT NULL")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@registered(QUERIES, f"WITH {_SNAPSHOTS} SELECT repo, (count(*) FILTER (WHERE status = 'added'))::BIGINT AS added, (count(*) FILTER (WHERE status = 'removed'))::BIGINT AS removed, (count(*) FILTER (WHERE status = 'changed'))::BIGINT AS changed FROM c WHERE status IS NOT NULL GROUP BY repo")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.change_counts(_changes(spark, sf_dir), ["repo"])


@registered(
    QUERIES,
    f"""WITH {_SNAPSHOTS}, a AS (SELECT * FROM c WHERE status = 'added')
SELECT DISTINCT repo, 'new-model' AS gate FROM a WHERE section = 'models' UNION SELECT repo, 'new-tool' FROM a WHERE section = 'tools'
UNION SELECT repo, 'new-external-provider' FROM a WHERE section = 'models' AND key IN ('1', '2', '3', '5', '8', '13', '21', '34')""",
)
def drift_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    providers = ["1", "2", "3", "5", "8", "13", "21", "34"]
    return drift.gates(_changes(spark, sf_dir), providers, ["new-model", "new-tool", "new-external-provider", "no-such-gate"])


@registered(
    QUERIES,
    """WITH m AS (SELECT min(ts) + INTERVAL 1 DAY AS since FROM events)
SELECT DISTINCT user_id, event_type FROM events, m WHERE ts >= since EXCEPT SELECT user_id, event_type FROM events, m WHERE ts < since""",
)
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that the first day never held; every event is on one side."""
    events = table(spark, sf_dir, "events")
    since = events.agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("since")).scalar()
    current = events.where(F.col("ts") >= since).select("user_id", "event_type").distinct()
    return R.novel(current, events.where(F.col("ts") < since), ["user_id", "event_type"])


@registered(
    QUERIES,
    """WITH r AS (SELECT DISTINCT event_type AS repo, strftime(ts, '%Y%m%d') AS run_id FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY run_id DESC) AS age FROM r)
SELECT e.event_id, k.repo, k.run_id FROM events e JOIN k ON e.event_type = k.repo AND strftime(e.ts, '%Y%m%d') = k.run_id WHERE k.age <= 3""",
)
def history_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("repo"), F.date_format("ts", "yyyyMMdd").alias("run_id"))
    return last_runs(runs, 3)


_EXCEPTIONS = [("Brand#11", "", "", "brand"), ("", "", "7", "size"), ("Brand#22", "", "9", "brand and size"), ("Brand#22", "", "", "later"), ("", "STANDARD", "", "type")]
_VALUES = ", ".join(f"({i}, '{b}', '{t}', '{s}', '{r}')" for i, (b, t, s, r) in enumerate(_EXCEPTIONS))


@registered(
    QUERIES,
    f"""WITH x(pos, b, t, s, reason) AS (VALUES {_VALUES})
SELECT p_partkey, arg_min(x.reason, x.pos) AS reason FROM part LEFT JOIN x ON (b = '' OR b = p_brand) AND (t = '' OR t = split_part(p_type, ' ', 1)) AND (s = '' OR s = p_size::VARCHAR) GROUP BY p_partkey""",
)
def exceptions_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(i, *x) for i, x in enumerate(_EXCEPTIONS)], "pos int, brand string, kind string, size string, reason string")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.substring_index("p_type", " ", 1).alias("kind"), F.col("p_size").cast("string").alias("size"))
    return R.match_exceptions(parts, known, ["brand", "kind", "size"]).select("p_partkey", "reason")


_ENTITIES = "e AS (SELECT p_brand AS repo, CASE p_partkey % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'tool' ELSE 'prompt_surface' END AS entity_type, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'ChatOpenAI' ELSE 'Local' END WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'SerpAPI' ELSE 'Tool' END ELSE 'prompt_templates' END AS name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'src/p' || p_partkey || '.py' END AS source_file FROM part)"
_POLICY = {"rule_overrides": {"exfil-surface": {"rule_id": "ORG-1", "threshold": 9, "allowlist": [{"entity_type": "tool", "source_file": "src/p7.py", "reason": "seen"}]}, "prompt-injection-surface": {"severity": "low"}, "third-party-provider": {"allowlist": [{"name": "ChatOpenAI", "source_file": "src/p6.py"}]}}}


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, "model").when(F.col("p_partkey") % 3 == 1, "tool").otherwise("prompt_surface")
    even = F.col("p_size") % 2 == 0
    name = F.when(F.col("p_partkey") % 3 == 0, F.when(even, "ChatOpenAI").otherwise("Local")).when(F.col("p_partkey") % 3 == 1, F.when(even, "SerpAPI").otherwise("Tool")).otherwise("prompt_templates")
    source = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".py")))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), kind.alias("entity_type"), name.alias("name"), source.alias("source_file"))


@registered(
    QUERIES,
    f"""WITH {_ENTITIES} SELECT repo, CASE entity_type WHEN 'model' THEN 'third-party-provider' WHEN 'tool' THEN 'exfil-surface' ELSE 'prompt-injection-surface' END || ':' || name || ':' || source_file AS id,
  CASE entity_type WHEN 'model' THEN CASE WHEN source_file = '' THEN 'high' ELSE 'critical' END WHEN 'tool' THEN CASE WHEN source_file = '' THEN 'high' ELSE 'critical' END ELSE 'medium' END AS severity,
  CASE entity_type WHEN 'model' THEN CASE WHEN source_file = '' THEN '0.660' ELSE '0.810' END WHEN 'tool' THEN CASE WHEN source_file = '' THEN '0.703' ELSE '0.853' END ELSE '0.593' END AS weighted_score
FROM e WHERE name IN ('ChatOpenAI', 'SerpAPI', 'prompt_templates')""",
)
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.evaluate(_entities(spark, sf_dir)).findings.select("repo", "id", "severity", "weighted_score")


@registered(
    QUERIES,
    f"""WITH {_ENTITIES}, m AS (SELECT *, CASE entity_type WHEN 'model' THEN 'third-party-provider' WHEN 'tool' THEN 'exfil-surface' ELSE 'prompt-injection-surface' END AS base FROM e WHERE name IN ('ChatOpenAI', 'SerpAPI', 'prompt_templates')),
x AS (SELECT *, CASE WHEN base = 'exfil-surface' AND source_file = 'src/p7.py' THEN 'seen' WHEN name = 'ChatOpenAI' AND source_file = 'src/p6.py' THEN 'allowlisted' END AS reason FROM m),
b(base, rule_id, threshold) AS (VALUES ('exfil-surface', 'ORG-1', 9), ('prompt-injection-surface', 'prompt-injection-surface', 1), ('third-party-provider', 'third-party-provider', 1)),
k AS (SELECT r.repo, b.*, (SELECT count(*) FROM x WHERE x.repo = r.repo AND x.base = b.base AND x.reason IS NULL) AS kept FROM (SELECT DISTINCT repo FROM e) r CROSS JOIN b)
SELECT repo, base AS base_rule_id, name, source_file, reason FROM x WHERE reason IS NOT NULL
UNION ALL SELECT repo, base, base, '', 'threshold-not-met: ' || kept || ' < ' || threshold FROM k WHERE kept < threshold""",
)
def policy_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.evaluate(_entities(spark, sf_dir), _POLICY).suppressed.select("repo", "base_rule_id", "name", "source_file", "reason")


@registered(
    QUERIES,
    f"""WITH {_TOOLED} SELECT repo, 'tool' AS entity_type, CASE kind WHEN 1 THEN 'search' || k WHEN 3 THEN 'tool' ELSE 'find' || k END AS name, path || CASE kind WHEN 3 THEN ':2' ELSE ':1' END AS source_file FROM m
UNION ALL SELECT DISTINCT repo, 'prompt_surface', 'prompt_templates', '' FROM m""",
)
def normalize_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the inventory: every tool, and one prompt surface a repository."""
    return inventory.entities(inventory.take_stock(tool_files(spark, sf_dir)))


@registered(
    QUERIES,
    """WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE lower(substr(o_orderpriority, 3)) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT o_orderstatus, o_orderkey, rank::INTEGER AS rank FROM r WHERE rank <= 3""",
)
def top_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    # the key as ten digits, so that the order of ids is that of the numbers
    risks = orders.select(F.col("o_orderstatus").alias("repo"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("id"), F.substring("o_orderpriority", 3, 100).alias("severity"), F.col("o_totalprice").alias("weighted_score"), F.lit("").alias("rationale"))
    found = report.top_risks(risks)
    return found.select(F.col("repo").alias("o_orderstatus"), F.col("id").cast("long").alias("o_orderkey"), "rank")


@registered(QUERIES, "WITH f AS (SELECT source, min(doc_id) AS first_id FROM documents GROUP BY source) SELECT d.doc_id, f.first_id FROM documents d LEFT JOIN f ON d.source = f.source")
def first_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    first = R.keep_first(docs, ["source"], ["doc_id"]).withColumnRenamed("doc_id", "first_id")
    return docs.join(first, "source", "left").select("doc_id", "first_id")


@registered(QUERIES, "SELECT c_custkey AS key, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'common' ELSE 'removed' END AS part FROM customer")
def key_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    common = customers.join(orders, "key", "left_semi").withColumn("part", F.lit("common"))
    return common.unionByName(R.novel(customers, orders, ["key"]).withColumn("part", F.lit("removed")))


@registered(
    QUERIES,
    """WITH b AS (SELECT event_type AS repo, 'scan:' || json_extract_string(props, '$.k') AS rule_id, json_extract_string(props, '$.k') AS rule_name FROM events
UNION ALL SELECT o_orderstatus, 'risk:' || o_orderpriority, o_orderpriority FROM orders)
SELECT repo, rule_id, min(rule_name) AS rule_name, min(rule_name) AS description FROM b WHERE rule_id IS NOT NULL GROUP BY repo, rule_id""",
)
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").isNotNull())
    findings = events.select(F.col("event_type").alias("repo"), F.col("event_id").cast("string").alias("id"), F.get_json_object("props", "$.k").alias("category"), F.lit("medium").alias("severity"), F.col("props").alias("evidence"), F.lit("f").alias("source_file"))
    orders = table(spark, sf_dir, "orders")
    risks = orders.select(F.col("o_orderstatus").alias("repo"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("rule_id"), F.col("o_orderpriority").alias("owasp_llm"), F.lit("high").alias("severity"), F.lit("r").alias("rationale"))
    return export.sarif(findings, risks)[1]


@registered(QUERIES, "SELECT source AS repo, CASE WHEN source IS NULL THEN 'error' ELSE 'ok' END AS status, count(*)::BIGINT AS files FROM documents WHERE source IS NOT NULL GROUP BY source")
def repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("repo"))
    counts = docs.groupBy("repo").agg(F.count("*").alias("files"))
    errors = spark.createDataFrame([], "repo string, reason string")
    return drift.repo_summary(docs, counts, errors).select("repo", "status", "files")
