"""Queries of predicate rules, canonical texts, sketched novelty and nested
documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.functions import columns as X
from stocktake.operators import drift, inventory, risk
from stocktake.operators import relational as R
from stocktake.plans.registry import Registry, registered, table
from stocktake.plans.source_queries import _MADE, part_files
from stocktake.sources import history
from stocktake.sources.nested import section_rows, write_nested
from stocktake.sources.work import Workspace

QUERIES: Registry = {}

_RULE = {"category": "supply chain", "owasp_llm": "LLM05", "default_severity": "low", "rationale": "Asked by predicate.", "confidence": 0.5, "exposure": 0.4, "with_source": 1.0, "without_source": 0.4, "control_mappings": ["X-1"], "evidence_requirements": ["provenance"]}
#: rules over provenance and paths
_MORE = [
    {**_RULE, "base_rule_id": "unknown-endpoint", "when": "entity_type = 'model' AND provider_endpoint = 'unknown'"},
    {**_RULE, "base_rule_id": "go-in-source", "when": "source_file RLIKE '^src/.*[.]go:' AND region IS NOT NULL"},
]


@registered(
    QUERIES,
    f"""WITH {_MADE}, h AS (SELECT repo, CASE kind WHEN 5 THEN 'unknown-endpoint' ELSE 'go-in-source' END AS base_rule_id, CASE kind WHEN 5 THEN 'ConfigModelHint' ELSE 'OpenAI' END AS name, 'src/p' || k || CASE kind WHEN 2 THEN '.go:1' ELSE '.yaml' END AS source_file FROM m WHERE kind IN (2, 5))
SELECT *, base_rule_id || ':' || name || ':' || source_file AS id, '0.585' AS weighted_score, 'medium' AS severity FROM h""",
)
def predicate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two rules that are predicates."""
    stock = inventory.take_stock(part_files(spark, sf_dir))
    found = risk.evaluate(inventory.described_entities(stock), more=_MORE).findings.where(F.col("base_rule_id").isin([r["base_rule_id"] for r in _MORE]))
    return found.select("repo", "base_rule_id", "name", "source_file", "id", "weighted_score", "severity")


_ESCAPED = "array_to_string(list_transform(regexp_extract_all({0}, '(?s).'), lambda c: CASE WHEN unicode(c) > 65535 THEN format('\\u{{:04x}}\\u{{:04x}}', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) WHEN unicode(c) > 126 THEN format('\\u{{:04x}}', unicode(c)) WHEN c = chr(10) THEN '\\n' WHEN c = chr(9) THEN '\\t' WHEN c = chr(13) THEN '\\r' WHEN c = '\"' THEN '\\\"' WHEN c = '\\' THEN '\\\\' ELSE c END), '')"


@registered(
    QUERIES,
    f"""SELECT doc_id, sha256('{{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"meta":{{"chars":' || n_chars || ',"source":' || coalesce('"' || source || '"', 'null') || '}},"text":' || coalesce('"' || {_ESCAPED.format("text")} || '"', 'null') || '}}') AS sha256 FROM documents""",
)
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the canonical texts of all documents."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.struct("text", F.struct("source", F.col("n_chars").alias("chars")).alias("meta"), "lang", "doc_id").alias("d"))
    return rows.select("doc_id", F.sha2(X.canonical(F.col("d"), rows.schema["d"].dataType), 256).alias("sha256"))


@registered(
    QUERIES,
    """WITH s AS (SELECT event_type AS repo, strftime(ts, '%Y%m%d') AS run_id, user_id::VARCHAR AS key, arg_max(props, (ts, event_id)) AS payload FROM events GROUP BY ALL),
r AS (SELECT repo, run_id, row_number() OVER (PARTITION BY repo ORDER BY run_id DESC) AS age FROM (SELECT DISTINCT repo, run_id FROM s))
SELECT s.repo, 'models' AS section, s.key, s.payload FROM s JOIN r USING (repo, run_id) WHERE age = 1
  AND (s.repo, s.key) NOT IN (SELECT (s.repo, s.key) FROM s JOIN r USING (repo, run_id) WHERE age BETWEEN 2 AND 4)""",
)
def sketched_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each repository's last run that none of its three runs before held,
    by the runs' sketches; the runs before are kept with them."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("repo"), F.lit("models").alias("section"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"), F.date_format("ts", "yyyyMMdd").alias("run_id"), "ts", "event_id")
    runs = R.keep_last(events, ["repo", "run_id", "section", "key"], ["ts", "event_id"]).drop("ts", "event_id")
    marked = runs.join(runs.groupBy("repo").agg(F.max("run_id").alias("newest")), "repo")
    path = Workspace(spark, "history").path("runs")
    history.append_runs(marked.where("run_id < newest").drop("newest"), path, cap=5, sketch=drift.KEY)
    return history.novel_keys(spark, path, marked.where("run_id = newest").select(*drift.KEY, "payload"), drift.KEY, 3)


_SECTIONS = ["models", "frameworks", "scan_findings", "tools"]


@registered(
    QUERIES,
    f"""WITH {_MADE} SELECT repo, (count(*) FILTER (WHERE kind < 6))::INTEGER AS n_models, (max(CASE WHEN kind = 4 THEN 1 ELSE 0 END) + max(CASE WHEN kind IN (0, 1, 5, 6) THEN 1 ELSE 0 END))::INTEGER AS n_frameworks,
  sum(CASE WHEN kind = 5 THEN 2 ELSE 1 END)::INTEGER AS n_findings, 0 AS n_tools, true AS in_order FROM m GROUP BY repo""",
)
def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every repository streamed into one file each, and read back."""
    stock = inventory.take_stock(part_files(spark, sf_dir))
    work = Workspace(spark, "nested")
    rows = section_rows({"models": stock.models, "frameworks": stock.frameworks, "scan_findings": stock.scan_findings, "tools": stock.tools})
    write_nested(rows, work.path("documents"), _SECTIONS)
    files = spark.read.text(work.path("documents"), wholetext=True)
    kinds = {"models": "model", "frameworks": "name", "scan_findings": "id", "tools": "name"}
    schema = ", ".join(f"{s} array<struct<{'source_file:string,' if s == 'models' else ''}{c}:string>>" for s, c in kinds.items())
    parsed = files.select(F.regexp_replace(F.regexp_extract(F.input_file_name(), "([^/]*)[.]json$", 1), "%2523|%23", "#").alias("repo"), F.from_json("value", schema).alias("d"), "value")
    names = F.transform("d.frameworks", lambda x: x["name"])
    return parsed.select("repo", F.size("d.models").alias("n_models"), F.size("d.frameworks").alias("n_frameworks"), F.size("d.scan_findings").alias("n_findings"), F.size("d.tools").alias("n_tools"), (F.array_sort(names) == names).alias("in_order"))
