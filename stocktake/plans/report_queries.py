"""Queries of profiles, references of exports, gates, policy files, lists and
documents read back, and of tools and prompts in line languages and scripts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.operators import detect, drift, export, inventory, report, risk
from stocktake.plans.history_queries import _ENTITIES, _POLICY, _entities
from stocktake.plans.inventory_queries import _FOUND, _OTHER, _stock, other_files
from stocktake.plans.registry import Registry, registered, table
from stocktake.plans.source_queries import _MADE, _TOOLED, part_contents, part_files, tool_files
from stocktake.sources import history
from stocktake.sources.tree import files_of, license_report, repo_list
from stocktake.sources.work import Workspace

QUERIES: Registry = {}

_API = "CASE kind WHEN 3 THEN 'https://api.anthropic.com' WHEN 5 THEN 'unknown' ELSE 'https://api.openai.com' END"


@registered(
    QUERIES,
    f"""WITH {_FOUND}, r AS (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY id) AS n FROM risks), t AS (SELECT repo, string_agg(id, '|' ORDER BY n) AS top FROM r WHERE n <= 3 GROUP BY repo),
a AS (SELECT repo, string_agg(type || ';' || n || ';' || source_file || ';' || {_API}, '|' ORDER BY type, n, source_file) AS assets FROM found GROUP BY repo),
w AS (SELECT repo, string_agg(name, '|' ORDER BY name) AS frameworks FROM fw GROUP BY repo)
SELECT c.repo, models::INTEGER AS n_models, c.frameworks::INTEGER AS n_frameworks, high_or_critical_risks::INTEGER AS n_severe, a.assets, w.frameworks AS frameworks, coalesce(t.top, '') AS top_risks, 9 AS n_detectors, (SELECT count(*) FROM m WHERE m.repo = c.repo)::INTEGER AS n_scanned, 0 AS unsupported_total
FROM counts c LEFT JOIN t USING (repo) LEFT JOIN a USING (repo) LEFT JOIN w USING (repo)""",
)
def ai_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of documents written and read back: assets with providers, top
    risks, coverage."""
    made = inventory.documents(inventory.take_stock(part_files(spark, sf_dir)))
    path = Workspace(spark, "profiles").path("documents")
    history.write_documents(made, path)
    p = report.ai_profile(history.read_documents(spark, path, inventory.DOCUMENT))
    assets = F.transform("ai_assets.models", lambda m: F.concat_ws(";", m["type"], m["model"], m["source_file"], m["provider"]))
    scanned = F.aggregate("detector_coverage.detectors", F.lit(0), lambda n, x: n + x["artifacts_scanned"])
    return p.select("repo", F.col("executive_summary.models").alias("n_models"), F.col("executive_summary.frameworks").alias("n_frameworks"), F.col("executive_summary.high_or_critical_risks").alias("n_severe"), F.array_join(assets, "|").alias("assets"), F.array_join("ai_assets.frameworks", "|").alias("frameworks"), F.array_join(F.transform("risk_highlights", lambda r: r["id"]), "|").alias("top_risks"), F.size("detector_coverage.detectors").alias("n_detectors"), scanned.alias("n_scanned"), F.col("detector_coverage.unsupported_total").alias("unsupported_total"))


@registered(
    QUERIES,
    f"""WITH {_FOUND},
x AS (SELECT f.*, CASE kind WHEN 5 THEN f.region ELSE coalesce(ctx.region, 'unknown') END AS of_region, {_API} AS endpoint FROM found f LEFT JOIN ctx USING (repo)),
p AS (SELECT repo, 'OTHER' AS category, 'stocktake-evidence-source' AS name, 'file:' || source_file AS value FROM x
UNION ALL SELECT repo, 'OTHER', 'stocktake:provenance:provider_endpoint', endpoint FROM x UNION ALL SELECT repo, 'OTHER', 'stocktake:provenance:region', of_region FROM x
UNION ALL SELECT repo, 'OTHER', 'stocktake:' || f, 'unknown' FROM x, (VALUES ('provenance:registry_uri'), ('provenance:immutable_version'), ('provenance:environment'), ('lineage:model_artifact_digest'), ('lineage:deployment_id'), ('lineage:service_account_identity'), ('lineage:owning_system')) v(f)
UNION ALL SELECT repo, 'OTHER', 'stocktake:detector:severity', 'medium' FROM x
UNION ALL SELECT repo, 'OTHER', 'stocktake:detector:source_type', CASE kind WHEN 0 THEN 'python' WHEN 1 THEN 'java_ast' WHEN 2 THEN 'go_ast' WHEN 3 THEN 'dotnet_ast' WHEN 4 THEN 'js_ts_ast' ELSE 'config' END FROM x
UNION ALL SELECT x.repo, 'SECURITY', 'advisory', 'stocktake-risk:' || r.id FROM x JOIN risks r ON x.repo = r.repo AND x.source_file = r.src)
SELECT repo, category, name, value, count(*)::BIGINT AS n FROM p GROUP BY ALL""",
)
def spdx_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of all packages: sources, provenance, what the detector said,
    and the risks that concern them."""
    found = export.spdx(*_stock(spark, sf_dir))[1].where("name <> 'stocktake:detector:confidence'")
    return found.groupBy("repo", "category", "name", "value").agg(F.count("*").alias("n"))


@registered(
    QUERIES,
    f"""WITH {_FOUND} SELECT repo, '| ' || repo || ' | ' || models || ' | 0 | 0 | ' || frameworks || ' | 0 | 0 | ' || high_or_critical_risks || ' |' AS line FROM counts""",
)
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of a table in markdown for each repository."""
    return report.markdown_summary(inventory.section_counts(*_stock(spark, sf_dir)).select("repo", *drift.COUNTS))


@registered(QUERIES, f"WITH {_OTHER} SELECT repo, 'max-unsupported' AS gate FROM m WHERE kind = 6 GROUP BY repo HAVING count(*) > 1")
def unsupported_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories with more than one file that no detector covers."""
    stock = inventory.take_stock(other_files(spark, sf_dir))
    findings = risk.evaluate(inventory.entities(stock)).findings
    return drift.scan_gates(inventory.section_counts(stock, findings), max_high_risk=1_000_000, max_unsupported=1)


@registered(
    QUERIES,
    f"""WITH {_MADE}, d AS (SELECT repo, k, CASE kind WHEN 0 THEN 'python' WHEN 1 THEN 'java_ast' WHEN 2 THEN 'go_ast' WHEN 3 THEN 'dotnet_ast' WHEN 4 THEN 'js_ts_ast' WHEN 5 THEN 'config' ELSE 'runtime_manifest' END AS source_type FROM m)
SELECT repo, source_type, count(*)::INTEGER AS artifacts_seen, (count(*) FILTER (WHERE k % 3 > 0))::INTEGER AS artifacts_scanned FROM d GROUP BY ALL""",
)
def undecodable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the files hold bytes that are no UTF-8: seen, but not scanned."""
    rows = part_contents(spark, sf_dir)
    number = F.regexp_extract("rel_path", "p([0-9]+)", 1).cast("long")
    files = files_of(rows.withColumn("content", F.when(number % 3 == 0, F.concat(F.col("content"), F.unhex(F.lit("FFFE")))).otherwise(F.col("content"))))
    return detect.detector_coverage(detect.all_facts(files)).where("artifacts_seen > 0").drop("default_confidence")


@registered(
    QUERIES,
    f"""WITH {_ENTITIES}, x AS (SELECT repo, CASE entity_type WHEN 'model' THEN 'third-party-provider' WHEN 'tool' THEN 'exfil-surface' ELSE 'prompt-injection-surface' END AS base, name, source_file, CASE WHEN entity_type = 'tool' AND source_file = 'src/p7.py' THEN 'seen' WHEN name = 'ChatOpenAI' AND source_file = 'src/p6.py' THEN 'allowlisted' END AS reason FROM e WHERE name IN ('ChatOpenAI', 'SerpAPI', 'prompt_templates'))
SELECT repo, base AS base_rule_id, name, source_file, reason, 'org' AS policy_id, '7' AS version FROM x WHERE reason IS NOT NULL""",
)
def policy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions of a policy that was read from its file."""
    place = Workspace(spark, "policy").path("policy.json")
    spark.createDataFrame([(json.dumps({**_POLICY, "policy_id": "org", "version": "7"}),)], "value string").coalesce(1).write.text(place)
    policy, source = risk.load_policy(spark, place)
    found = risk.evaluate(_entities(spark, sf_dir), policy).suppressed.where("entity_type <> 'rule'")
    return found.select("repo", "base_rule_id", "name", "source_file", "reason", F.lit(source["policy_id"]).alias("policy_id"), F.lit(source["version"]).alias("version"))


@registered(
    QUERIES,
    f"""WITH {_ENTITIES} SELECT repo, 'exfil-surface:' || name || ':' || source_file AS id, CASE WHEN source_file = '' THEN 0.688 ELSE 0.838 END::DOUBLE AS score, 0.5::DOUBLE AS confidence, 0.25::DOUBLE AS exposure, 0.25::DOUBLE AS provenance FROM e WHERE name = 'SerpAPI'""",
)
def weighted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a rule with weights of its own, which are made to sum to one."""
    found = risk.evaluate(_entities(spark, sf_dir), {"rule_overrides": {"exfil-surface": {"weights": {"confidence": 2, "exposure": 1, "provenance": 1}}}})
    weights = found.applied.where("base_rule_id = 'exfil-surface'").select("repo", "effective_weights.*")
    rows = found.findings.where("base_rule_id = 'exfil-surface'").select("repo", "id", F.col("weighted_score").cast("double").alias("score"))
    return rows.join(weights, "repo")


@registered(
    QUERIES,
    """WITH b AS (SELECT DISTINCT p_brand AS repo FROM part), f AS (SELECT repo, 0 AS first FROM b WHERE suffix(repo, '1') UNION ALL SELECT repo, 1 FROM b WHERE NOT suffix(repo, '1'))
SELECT repo, (row_number() OVER (ORDER BY first, repo))::INTEGER AS rank FROM f""",
)
def listed_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list file with comments, blank lines and repeated names, behind names
    that are given first."""
    from pyspark.sql import Window

    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo")).distinct()
    place = Workspace(spark, "list").path("repos")
    body = brands.groupBy().agg(F.array_sort(F.collect_list("repo")).alias("all"))  # twenty-five names
    body.select(F.concat(F.lit("# all\n\n"), F.array_join("all", "\n"), F.lit("\n  "), F.array_join("all", "  \n"), F.lit("\n")).alias("value")).coalesce(1).write.text(place)
    first = sorted(r.repo for r in brands.where(F.col("repo").endswith("1")).collect())
    found = repo_list(spark, place, first)
    return found.select("repo", F.row_number().over(Window.orderBy("place")).alias("rank"))


@registered(
    QUERIES,
    """SELECT 'part-' || p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'copyleft' WHEN 2 THEN 'unknown' ELSE 'unlisted' END AS verdict FROM part""",
)
def license_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a report of packages and their licenses."""
    place = Workspace(spark, "licenses").path("report")
    name = F.when(F.col("p_partkey") % 4 == 0, "MIT License").when(F.col("p_partkey") % 4 == 1, "GPL v3").when(F.col("p_partkey") % 4 == 3, "Custom")
    table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("Name"), name.alias("License")).write.json(place)
    found = license_report(spark, place, lines=True)
    return found.select("name", "verdict")


@registered(
    QUERIES,
    f"""WITH {_TOOLED} SELECT repo, 'tool' AS kind, CASE kind WHEN 0 THEN 'find' || k WHEN 1 THEN 'search' || k WHEN 2 THEN 'find' || k ELSE 'tool' END AS name, path || CASE kind WHEN 3 THEN ':2' ELSE ':1' END AS source_file, NULL AS template FROM m
UNION ALL SELECT repo, 'prompt', path || CASE kind WHEN 3 THEN ':3' ELSE ':2' END, path || CASE kind WHEN 3 THEN ':3' ELSE ':2' END, 'template ' || k FROM m""",
)
def tools_and_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools and prompts of Java, Go, C# and scripts."""
    stock = inventory.take_stock(tool_files(spark, sf_dir), include_prompts=True)
    tools = stock.tools.select("repo", F.lit("tool").alias("kind"), "name", "source_file", F.lit(None).cast("string").alias("template"))
    return tools.unionByName(stock.prompts.select("repo", F.lit("prompt").alias("kind"), F.col("id").alias("name"), "source_file", "template"))
