"""Queries of the text and column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.functions import columns as X
from stocktake.functions.parsers import setting_leaves_of
from stocktake.operators import inventory, risk
from stocktake.operators.export import manifest
from stocktake.operators.relational import coverage, first_distinct, keep_first, unpivot_known
from stocktake.plans.registry import Registry, registered, table
from stocktake.plans.source_queries import _TOOLED, tool_files

QUERIES: Registry = {}


@registered(QUERIES, "SELECT doc_id, CASE WHEN text = '' THEN 0 WHEN suffix(text, chr(10)) THEN len(string_split(text, chr(10))) - 1 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines FROM documents")
def lines_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.lines("text")).cast("long").alias("n_lines"))


@registered(
    QUERIES,
    """WITH t AS (SELECT doc_id, regexp_extract(text, 'token = "([0-9a-f]{40})"', 1) AS v FROM documents)
SELECT doc_id, 'token=[masked:' || left(v, 2) || repeat('*', length(v) - 4) || right(v, 2) || ' hash:' || left(sha256(v), 12) || ']' AS evidence FROM t WHERE v <> ''""",
)
def redact_mask_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", 'token = "([0-9a-f]{40})"', 1).alias("v")).where("v <> ''")
    return rows.select("doc_id", X.config_evidence(F.lit("token"), F.col("v"), strict=True).alias("evidence"))


@registered(QUERIES, "SELECT sha256(text) AS text_sha256, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("text_sha256"), "doc_id", "source")
    return keep_first(rows, ["text_sha256"], ["doc_id"])


@registered(QUERIES, "SELECT 'page-' || page_id || '.html' AS name, sha256(html) AS sha256 FROM pages")
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html"))
    return manifest(table(spark, sf_dir, "pages"), name, F.col("html"))


@registered(
    QUERIES,
    """WITH t AS (SELECT doc_id, regexp_extract(text, '(MIT License|Apache License|[A-Z]*GPL)', 1) AS l FROM documents)
SELECT doc_id, l AS license, CASE WHEN l = '' THEN 'unknown' WHEN contains(l, 'GPL') THEN 'copyleft' WHEN l = 'MIT License' THEN 'ok' ELSE 'unlisted' END AS verdict FROM t""",
)
def license_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", "(MIT License|Apache License|[A-Z]*GPL)", 1).alias("license"))
    return rows.withColumn("verdict", X.license_verdict(F.col("license")))


@registered(QUERIES, "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(setting_leaves_of("props")).alias("p"))
    return rows.select("event_id", "p.key", "p.value")


_IMAGED = "html || '<img src=\"reg.io/p' || page_id || ':1@sha256:' || sha256(page_id::VARCHAR) || '\">'"


@registered(QUERIES, f"SELECT page_id, unnest(regexp_extract_all({_IMAGED}, '([\\w./:-]+@sha256:[a-fA-F0-9]{{64}})', 1)) AS image FROM pages")
def html_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to images by digest in pages that got one each."""
    name = F.col("page_id").cast("string")
    page = F.concat(F.col("html"), F.lit('<img src="reg.io/p'), name, F.lit(":1@sha256:"), F.sha2(name, 256), F.lit('">'))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(X.image_refs(page)).alias("image"))


_SLUG = "coalesce(nullif(trim(regexp_replace({}, '[^A-Za-z0-9.-]+', '-', 'g'), '-'), ''), 'unknown')"


@registered(
    QUERIES,
    f"""SELECT p_partkey, 'SPDXRef-Part-' || {_SLUG.format("p_name")} || '-' || {_SLUG.format("p_brand")} || '-' || left(sha256(p_name || '::' || p_brand || '::'), 10) AS spdx_id,
  'asset-' || left(sha256('library:' || p_name || ':' || p_brand || ':'), 16) AS bom_ref FROM part""",
)
def part_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand, none = F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", X.spdx_id(F.lit("Part"), name, brand, none).alias("spdx_id"), X.bom_ref(F.lit("library"), name, brand, none).alias("bom_ref"))


@registered(
    QUERIES,
    """SELECT p_partkey, name, value FROM (
  SELECT p_partkey, 'p_brand' AS name, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part
  UNION ALL SELECT p_partkey, 'label', CASE WHEN p_size > 25 THEN 'large' ELSE '' END FROM part) WHERE value <> ''""",
)
def provenance_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("label", F.when(F.col("p_size") > 25, "large").otherwise(""))
    return unpivot_known(rows, ["p_partkey"], ["p_brand", "p_type", "label"])


@registered(
    QUERIES,
    """WITH s AS (SELECT o_orderkey, lower(substr(o_orderpriority, 3)) AS s FROM orders)
SELECT o_orderkey, CASE WHEN s = 'high' THEN 'affected' WHEN s = 'medium' THEN 'under_investigation' ELSE 'not_affected' END AS status,
  CASE s WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END::INTEGER AS rank FROM s""",
)
def vex_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.lower(F.substring("o_orderpriority", 3, 100))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.vex_status(severity).alias("status"), X.severity_rank(severity).alias("rank"))


@registered(
    QUERIES,
    """WITH n AS (SELECT doc_id, regexp_matches(text, 'token = ')::INT + regexp_matches(text, '[a-z]@[a-z]')::INT + regexp_matches(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')::INT AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n >= 2 THEN 'high' WHEN n = 1 THEN 'medium' ELSE 'low' END AS confidence FROM n""",
)
def confidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = [F.col("text").rlike(p) for p in ("token = ", "[a-z]@[a-z]", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+")]
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.confidence_of(signals).alias("confidence"))


@registered(
    QUERIES,
    """SELECT page_id, string_split(url, '/')[-1] AS name, list_has_any(string_split(url, '/'), ['.venv', 'venv', '__pycache__', '.git', '.stocktake']) AS ignored, regexp_extract(string_split(url, '/')[-1], '^.+([.][^.]+)$', 1) AS suffix FROM pages""",
)
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.file_name("url").alias("name"), X.is_ignored("url").alias("ignored"), X.suffix("url").alias("suffix"))


@registered(
    QUERIES,
    """WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), d AS (SELECT d.source, l.doc_id IS NOT NULL AS done FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)
SELECT s.source, count(d.source)::BIGINT AS seen, (count(*) FILTER (WHERE d.done))::BIGINT AS scanned FROM s LEFT JOIN d ON s.source = d.source GROUP BY s.source""",
)
def coverage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    seen = docs.join(labels, "doc_id", "left")
    return coverage(docs.where("source IS NOT NULL"), seen, "source", F.coalesce("labelled", F.lit(False)))


@registered(
    QUERIES,
    """WITH d AS (SELECT DISTINCT l_suppkey, lpad(l_partkey::VARCHAR, 8, '0') AS dep FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY dep) AS n FROM d)
SELECT l_suppkey, string_agg(dep, ', ' ORDER BY dep) AS listed FROM r WHERE n <= 10 GROUP BY l_suppkey""",
)
def dependency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("dep"))
    return first_distinct(rows, ["l_suppkey"], "dep", 10)


@registered(QUERIES, "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created FROM events")
def timestamp_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    compact = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")
    return table(spark, sf_dir, "events").select("event_id", X.normal_timestamp(compact).alias("created"))


@registered(
    QUERIES,
    f"""WITH {_TOOLED} SELECT repo, 0::BIGINT AS models, count(*)::BIGINT AS tools, 0::BIGINT AS datasets, max(CASE WHEN kind = 3 THEN 1 ELSE 0 END)::BIGINT AS frameworks, count(*)::BIGINT AS prompts, 0::BIGINT AS unsupported_artifacts, 0::BIGINT AS high_or_critical_risks FROM m GROUP BY repo""",
)
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every section of an inventory of tools and prompts."""
    stock = inventory.take_stock(tool_files(spark, sf_dir))
    return inventory.section_counts(stock, risk.evaluate(inventory.entities(stock)).findings)
