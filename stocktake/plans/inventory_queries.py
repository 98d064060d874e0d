"""Queries of notebooks, lock files, images, credentials, unreadable files, and
of reports and exports of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.operators import detect, drift, export, inventory, report, risk
from stocktake.plans.history_queries import _ENTITIES, _POLICY, _entities
from stocktake.plans.registry import Registry, registered, table
from stocktake.plans.source_queries import _MADE, part_files
from stocktake.plans.text_queries import _SLUG
from stocktake.sources.tree import files_of

QUERIES: Registry = {}

# path and text of each kind; {n} is the part's name, {k} its key, {s} its size, {h} a hash
_KINDS = [
    ("nb{k}.ipynb", '{{"cells": [{{"cell_type": "markdown", "source": "x"}}, {{"cell_type": "code", "source": ["from openai import OpenAI\\n", "c = OpenAI(model=\'{n}\')"]}}]}}'),
    ("w{k}/package.json", '{{"dependencies": {{"langchain": "1", "zz{k}": "2"}}}}'),
    ("w{k}/yarn.lock", '"@scope/p{k}@^1":\nleft-pad@1.0:\n'),
    ("d{k}/Dockerfile", "FROM reg.io/img{k}:1.0\n"),
    ("k8s/app{k}.yaml", "image: reg.io/app{k}@sha256:{h}\nowner: team{s}\n"),
    ("e{k}/.env", "OPENAI_API_KEY=key-{k}-secret\nREGION=eu\n"),
    ("t{k}/settings.toml", "[x]\n"),
    ("b{k}.py", "def (\n"),
]


def other_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    values = {"n": F.col("p_name"), "k": F.col("p_partkey").cast("string"), "s": F.col("p_size").cast("string"), "h": F.sha2(F.col("p_partkey").cast("string"), 256)}

    def filled(template: str):  # noqa: ANN202
        marked = template.format(n="\0n\0", k="\0k\0", s="\0s\0", h="\0h\0").split("\0")
        return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(marked)])

    pick = F.array(*[F.struct(filled(path).alias("rel_path"), filled(text).cast("binary").alias("content")) for path, text in _KINDS])
    rows = part.select(F.col("p_brand").alias("repo"), F.element_at(pick, (F.col("p_partkey") % len(_KINDS) + 1).cast("int")).alias("f"))
    return files_of(rows.select("repo", "f.rel_path", "f.content"))


_OTHER = "m AS (SELECT p_brand AS repo, p_partkey AS k, p_partkey % 8 AS kind, p_name AS n, p_size AS s, sha256(p_partkey::VARCHAR) AS h FROM part)"


@registered(QUERIES, f"WITH {_OTHER} SELECT repo, n AS model, 'nb' || k || '.ipynb#cell-1' AS source_file FROM m WHERE kind = 0")
def notebook_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inventory.take_stock(other_files(spark, sf_dir)).models
    return found.select("repo", "model", "source_file")


@registered(
    QUERIES,
    f"""WITH {_OTHER} SELECT repo, 'js-ts-deps:w' || k || CASE kind WHEN 1 THEN '/package.json' ELSE '/yarn.lock' END AS id,
  'Detected JS/TS dependencies: ' || CASE kind WHEN 1 THEN 'langchain, zz' || k ELSE '@scope/p' || k || ', left-pad' END AS evidence FROM m WHERE kind IN (1, 2)""",
)
def script_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = detect.scan(other_files(spark, sf_dir), only=["js_ts_manifest"])
    return facts.where("kind = 'finding'").select("repo", F.col("name").alias("id"), F.col("value").alias("evidence"))


@registered(
    QUERIES,
    f"""WITH {_OTHER}, p AS (SELECT *, 'k8s/app' || k || '.yaml' AS path, 'reg.io/app' || k || '@sha256:' || h AS ref FROM m WHERE kind = 4)
SELECT repo, 'runtime-image-digest:' || path || ':' || ref AS id, 'Immutable OCI image reference detected: ' || ref AS evidence FROM p
UNION ALL SELECT repo, 'runtime-lineage:' || path || ':owner', 'owner=team' || s FROM p
UNION ALL SELECT repo, 'runtime-ai-config:' || path || ':image', left('image=' || left(ref, 80), 200) FROM p
UNION ALL SELECT repo, 'runtime-container:' || path, 'Container/runtime metadata discovered.' FROM p
UNION ALL SELECT repo, 'runtime-container:d' || k || '/Dockerfile', 'Container/runtime metadata discovered.' FROM m WHERE kind = 3""",
)
def image_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inventory.take_stock(other_files(spark, sf_dir)).scan_findings
    return found.where("source_type = 'runtime_manifest'").select("repo", "id", "evidence")


@registered(
    QUERIES,
    f"""WITH {_OTHER}, y AS (SELECT repo, arg_max('reg.io/app' || k || '@sha256:' || h, 'app' || k || '.yaml') AS ref, arg_max('team' || s, 'app' || k || '.yaml') AS team FROM m WHERE kind = 4 GROUP BY repo),
d AS (SELECT repo, arg_max('reg.io/img' || k, 'd' || k) AS image FROM m WHERE kind = 3 GROUP BY repo), e AS (SELECT DISTINCT repo FROM m WHERE kind = 5)
SELECT repo, coalesce(y.ref, d.image || ':1.0') AS immutable_version, coalesce(split_part(y.ref, '@', 1), d.image) AS registry_uri, y.team AS owning_system, CASE WHEN e.repo IS NOT NULL THEN 'eu' END AS region
FROM y FULL JOIN d USING (repo) FULL JOIN e USING (repo)""",
)
def lineage_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.take_stock(other_files(spark, sf_dir)).context.select("repo", "immutable_version", "registry_uri", "owning_system", "region")


@registered(
    QUERIES,
    f"""WITH {_OTHER}, v AS (SELECT repo, k, 'key-' || k || '-secret' AS v FROM m WHERE kind = 5)
SELECT repo, 'config:openai_api_key:e' || k || '/.env' AS id, 'high' AS severity, 'OPENAI_API_KEY=[masked:' || left(v, 2) || repeat('*', length(v) - 4) || right(v, 2) || ' hash:' || left(sha256(v), 12) || ']' AS evidence FROM v""",
)
def credential_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inventory.take_stock(other_files(spark, sf_dir)).scan_findings
    return found.where("category = 'provider credential'").select("repo", "id", "severity", "evidence")


@registered(QUERIES, f"WITH {_OTHER} SELECT repo, 't' || k || '/settings.toml' AS path, '.toml' AS artifact_type FROM m WHERE kind = 6")
def unsupported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.take_stock(other_files(spark, sf_dir)).unsupported.select("repo", "path", "artifact_type")


@registered(
    QUERIES,
    f"""WITH {_OTHER}, r AS (SELECT repo, count(*) FILTER (WHERE kind = 7) AS py, count(*) FILTER (WHERE kind = 0) AS nb FROM m GROUP BY repo)
SELECT repo, 'python' AS source_type, py::INTEGER AS artifacts_seen, 0 AS artifacts_scanned FROM r UNION ALL SELECT repo, 'jupyter_notebook', nb::INTEGER, nb::INTEGER FROM r""",
)
def unreadable_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = other_files(spark, sf_dir)
    found = detect.detector_coverage(detect.scan(files), files).where("source_type IN ('python', 'jupyter_notebook')")
    return found.select("repo", "source_type", "artifacts_seen", "artifacts_scanned")


# ---- reports and exports over the files of source_queries ----

_FOUND = f"""{_MADE}, found AS (SELECT m.*, CASE kind WHEN 3 THEN 'Anthropic' WHEN 4 THEN 'ChatOpenAI' WHEN 5 THEN 'ConfigModelHint' ELSE 'OpenAI' END AS type,
  'src/p' || k || CASE kind WHEN 0 THEN '.py' WHEN 1 THEN '.java:2' WHEN 2 THEN '.go:1' WHEN 3 THEN '.cs:1' WHEN 4 THEN '.ts:2' ELSE '.yaml' END AS source_file FROM m WHERE kind < 6),
fw AS (SELECT DISTINCT repo, CASE WHEN kind = 4 THEN 'langchain' ELSE 'openai' END AS name FROM m WHERE kind IN (0, 1, 4, 5, 6)),
risks AS (SELECT repo, 'third-party-provider:' || type || ':' || source_file AS id, split_part(source_file, ':', -1) AS src FROM found WHERE kind IN (0, 1, 2, 4)),
counts AS (SELECT repo, count(*) FILTER (WHERE kind < 6) AS models, 0 AS tools, 0 AS datasets, max(CASE WHEN kind = 4 THEN 1 ELSE 0 END) + max(CASE WHEN kind IN (0, 1, 5, 6) THEN 1 ELSE 0 END) AS frameworks, 0 AS prompts, 0 AS unsupported_artifacts, count(*) FILTER (WHERE kind IN (0, 1, 2, 4)) AS high_or_critical_risks FROM m GROUP BY repo)"""


def _stock(spark: SparkSession, sf_dir: str) -> tuple[inventory.Inventory, DataFrame]:
    stock = inventory.take_stock(part_files(spark, sf_dir))
    return stock, risk.evaluate(inventory.entities(stock)).findings


@registered(QUERIES, f"WITH {_FOUND} SELECT repo, models::BIGINT AS models, tools::BIGINT AS tools, datasets::BIGINT AS datasets, frameworks::BIGINT AS frameworks, prompts::BIGINT AS prompts, unsupported_artifacts::BIGINT AS unsupported_artifacts, high_or_critical_risks::BIGINT AS high_or_critical_risks FROM counts")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.section_counts(*_stock(spark, sf_dir))


@registered(QUERIES, f"WITH {_FOUND} SELECT repo, 'max-high-risk' AS gate FROM counts WHERE high_or_critical_risks > 4")
def scan_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.scan_gates(inventory.section_counts(*_stock(spark, sf_dir)), max_high_risk=4, max_unsupported=0)


@registered(
    QUERIES,
    f"""WITH {_FOUND}, top AS (SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY id) AS n FROM risks), t AS (SELECT repo, string_agg(chr(10) || '- [critical] ' || id, '' ORDER BY n) AS listed FROM top WHERE n <= 3 GROUP BY repo)
SELECT c.repo, 'inventory of ' || c.repo || chr(10) || 'models: ' || models || chr(10) || 'tools: 0' || chr(10) || 'datasets: 0' || chr(10) || 'frameworks: ' || frameworks || chr(10) || 'prompts: 0' || chr(10) || 'unsupported artifacts: 0' || chr(10) || 'high or critical risks: ' || high_or_critical_risks || coalesce(t.listed, '') AS text FROM counts c LEFT JOIN t ON c.repo = t.repo""",
)
def text_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock, found = _stock(spark, sf_dir)
    return report.text_summary(report.profile(inventory.section_counts(stock, found), found))


@registered(QUERIES, f"WITH {_FOUND} SELECT repo, id AS vulnerability, 'file:' || src AS product, 'not_affected' AS status FROM risks")
def vex_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.vex(_stock(spark, sf_dir)[1]).select("repo", "vulnerability", "product", "status")


@registered(
    QUERIES,
    f"""WITH {_FOUND} SELECT repo, 'stocktake-' || left(sha256('application:' || type || ':' || n || ':' || source_file), 16) AS bom_ref, 'application' AS type, type AS name, n AS version FROM found
UNION ALL SELECT repo, 'stocktake-' || left(sha256('library:' || name || ':unknown:'), 16), 'library', name, 'unknown' FROM fw""",
)
def cyclonedx_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.cyclonedx(*_stock(spark, sf_dir))[0].select("repo", "bom_ref", "type", "name", "version")


@registered(
    QUERIES,
    f"""WITH {_FOUND}, c AS (SELECT repo, source_file, 'stocktake-' || left(sha256('application:' || type || ':' || n || ':' || source_file), 16) AS ref FROM found)
SELECT r.repo, r.id, count(c.ref)::INTEGER AS n_affected, min(c.ref) AS affected FROM risks r LEFT JOIN c ON r.repo = c.repo AND r.src = c.source_file GROUP BY r.repo, r.id""",
)
def cyclonedx_vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = export.cyclonedx(*_stock(spark, sf_dir))[2]
    return found.select("repo", "id", F.size("affects").alias("n_affected"), F.try_element_at("affects", F.lit(1)).alias("affected"))


@registered(
    QUERIES,
    f"""WITH {_FOUND}, c AS (SELECT repo, lower(type) AS low, 'stocktake-' || left(sha256('application:' || type || ':' || n || ':' || source_file), 16) AS ref, 0 AS ord, type AS name, n AS version, source_file AS src FROM found
UNION ALL SELECT repo, name, 'stocktake-' || left(sha256('library:' || name || ':unknown:'), 16), 3, name, 'unknown', '' FROM fw),
first AS (SELECT repo, low, arg_min(ref, (ord, name, version, src)) AS ref FROM c GROUP BY ALL)
SELECT repo, string_agg(DISTINCT ref, ',' ORDER BY ref) AS depends_on FROM first WHERE low = 'openai' AND repo IN (SELECT repo FROM m WHERE kind = 6) GROUP BY repo""",
)
def document_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = export.root_dependencies(export.cyclonedx(*_stock(spark, sf_dir))[1])
    return found.select("repo", F.array_join("depends_on", ",").alias("depends_on"))


@registered(
    QUERIES,
    """WITH d AS (SELECT 'r' || p_partkey AS repo, CASE p_partkey % 4 WHEN 0 THEN sha256(p_name) WHEN 1 THEN 'DYNAMIC' WHEN 2 THEN '' END AS a, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN '' END AS g, p_name AS t FROM part),
s AS (SELECT repo, CASE WHEN x <> 'DYNAMIC' THEN x ELSE sha256(t) END AS seed FROM (SELECT *, CASE WHEN a <> '' THEN a WHEN g <> '' THEN g END AS x FROM d)),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('stocktake:' || seed)) AS b, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('stocktake:vex:' || seed)) AS v FROM s)
SELECT repo, seed, """
    + ", ".join(f"'urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || translate({h}[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || {h}[18:20] || '-' || {h}[21:32] AS {name}" for h, name in (("b", "bom_serial"), ("v", "vex_id")))
    + " FROM h",
)
def export_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of documents that have a hash, a commit, a placeholder, or none."""
    key = F.col("p_partkey")
    artifact = F.when(key % 4 == 0, F.sha2("p_name", 256)).when(key % 4 == 1, "DYNAMIC").when(key % 4 == 2, "")
    commit = F.when(key % 3 == 0, F.col("p_type")).when(key % 3 == 1, "")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), key.cast("string")).alias("repo"), artifact.alias("artifact_sha256"), commit.alias("git_sha"), F.col("p_name").alias("document"))
    return export.serials(rows)


@registered(
    QUERIES,
    f"""WITH {_FOUND} SELECT repo, 'SPDXRef-Model-' || type || '-' || {_SLUG.format("n")} || '-' || {_SLUG.format("source_file")} || '-' || left(sha256(type || '::' || n || '::' || source_file), 10) AS spdx_id, type AS name, n AS version_info FROM found
UNION ALL SELECT repo, 'SPDXRef-Framework-' || name || '-unknown-' || left(sha256(name || '::unknown::'), 10), name, 'unknown' FROM fw""",
)
def spdx_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.spdx(*_stock(spark, sf_dir))[0].select("repo", "spdx_id", "name", "version_info")


@registered(
    QUERIES,
    f"""WITH {_FOUND}, s AS (SELECT repo, 'scan:model invocation' AS rule_id, 'medium' AS level FROM found WHERE kind < 5 UNION ALL SELECT repo, 'scan:' || c, 'medium' FROM m, (VALUES ('model configuration'), ('provider configuration')) v(c) WHERE kind = 5
UNION ALL SELECT repo, 'scan:dependency graph', 'medium' FROM m WHERE kind = 6 UNION ALL SELECT repo, 'risk:third-party-provider', 'critical' FROM risks)
SELECT repo, rule_id, level, count(*)::BIGINT AS n FROM s GROUP BY ALL""",
)
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock, found = _stock(spark, sf_dir)
    return export.sarif(stock.scan_findings, found)[0].groupBy("repo", "rule_id", "level").agg(F.count("*").alias("n"))


@registered(
    QUERIES,
    f"""WITH {_MADE}, d AS (SELECT repo, json_object('n', (count(*) FILTER (WHERE kind < 6))::INTEGER) AS j, (count(*) FILTER (WHERE kind < 6))::INTEGER AS n_models, (count(*) FILTER (WHERE kind IN (0, 1, 2, 4)))::INTEGER AS n_risks,
  max(CASE WHEN kind = 4 THEN 1 ELSE 0 END) + max(CASE WHEN kind IN (0, 1, 5, 6) THEN 1 ELSE 0 END) AS n_frameworks FROM m GROUP BY repo)
SELECT repo, n_models, n_frameworks, n_risks, 9 AS n_detectors, 9 AS n_source_types, 0 AS unsupported_total, '1.0' AS schema_version, 'builtin-default' AS policy_id FROM d""",
)
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back by their schema."""
    made = inventory.documents(inventory.take_stock(part_files(spark, sf_dir)))
    rows = made.select("repo", F.from_json("document", inventory.DOCUMENT).alias("d"))
    size = lambda c: F.size(f"d.{c}")
    return rows.select("repo", size("models").alias("n_models"), size("frameworks").alias("n_frameworks"), size("risk_findings").alias("n_risks"), size("coverage_summary.detectors").alias("n_detectors"), size("source_types").alias("n_source_types"), F.col("d.coverage_summary.unsupported_total").alias("unsupported_total"), F.col("d.schema_version").alias("schema_version"), F.col("d.risk_policy.policy.policy_id").alias("policy_id"))


@registered(
    QUERIES,
    f"""WITH {_ENTITIES}, x AS (SELECT *, CASE entity_type WHEN 'model' THEN 'third-party-provider' WHEN 'tool' THEN 'exfil-surface' ELSE 'prompt-injection-surface' END AS base FROM e WHERE name IN ('ChatOpenAI', 'SerpAPI', 'prompt_templates')),
b(base, rule_id, severity) AS (VALUES ('exfil-surface', 'ORG-1', 'high'), ('prompt-injection-surface', 'prompt-injection-surface', 'low'), ('third-party-provider', 'third-party-provider', 'medium')),
k AS (SELECT repo, base, count(*) AS candidates, count(*) FILTER (WHERE NOT (base = 'exfil-surface' AND source_file = 'src/p7.py' OR name = 'ChatOpenAI' AND source_file = 'src/p6.py')) AS kept FROM x GROUP BY ALL)
SELECT r.repo, b.base AS base_rule_id, b.rule_id, b.severity, coalesce(k.candidates, 0)::BIGINT AS candidate_count, coalesce(k.kept, 0)::BIGINT AS post_allowlist_count
FROM (SELECT DISTINCT repo FROM e) r CROSS JOIN b LEFT JOIN k ON k.repo = r.repo AND k.base = b.base""",
)
def policy_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.evaluate(_entities(spark, sf_dir), _POLICY).applied.select("repo", "base_rule_id", "rule_id", "severity", "candidate_count", "post_allowlist_count")


@registered(
    QUERIES,
    """WITH s AS (SELECT event_type AS repo, strftime(ts, '%Y%m%d') AS run_id, 'models' AS section, user_id::VARCHAR AS key, arg_max(props, (ts, event_id)) AS payload FROM events GROUP BY ALL),
r AS (SELECT repo, run_id, row_number() OVER (PARTITION BY repo ORDER BY run_id DESC) AS age FROM (SELECT DISTINCT repo, run_id FROM s))
SELECT s.repo, s.section, s.key FROM s JOIN r USING (repo, run_id) WHERE age = 1
EXCEPT SELECT s.repo, s.section, s.key FROM s JOIN r USING (repo, run_id) WHERE age BETWEEN 2 AND 4""",
)
def trend_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each repository's last run that none of its three runs before held."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("repo"), F.date_format("ts", "yyyyMMdd").alias("run_id"), F.lit("models").alias("section"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"), "ts", "event_id")
    runs = drift.keep_last(events, ["repo", "run_id", "section", "key"], ["ts", "event_id"]).drop("ts", "event_id")
    newest = runs.groupBy("repo").agg(F.max("run_id").alias("newest"))
    marked = runs.join(newest, "repo")
    current = marked.where("run_id = newest").select(*drift.KEY, "payload")
    earlier = marked.where("run_id < newest").drop("newest")
    return drift.trend(current, earlier, 3)[1].select("repo", "section", "key")
