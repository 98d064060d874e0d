"""The inventory: from facts to deduplicated sections, and to one document for
each repository."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake import constants as C
from stocktake.functions import columns as X
from stocktake.operators import detect, risk
from stocktake.operators.relational import fill_from, keep_first, merge_last_known
from stocktake.sources.work import Workspace

ORDER = ["ordinal", "place", "seq"]
CONTEXT = C.PROVENANCE_FIELDS + C.LINEAGE_FIELDS


@dataclass
class Inventory:
    """Sections as flat tables that begin with ``repo``."""

    models: DataFrame
    datasets: DataFrame
    tools: DataFrame
    prompts: DataFrame
    frameworks: DataFrame
    scan_findings: DataFrame
    context: DataFrame
    coverage: DataFrame
    unsupported: DataFrame
    #: where the facts are kept, if they were written for it
    work: Workspace | None = None

    def release(self) -> None:
        """Drop the facts; no section may be read after it.  Without it they stay
        until the driver ends."""
        if self.work is not None:
            self.work.drop()


def _wide(merged: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each ``keys`` with a column for each field of the context."""
    picks = [F.max(F.when(F.col("name") == f, F.col("value"))).alias(f) for f in CONTEXT]
    return merged.groupBy(*keys).agg(*picks)


def runtime_context(facts: DataFrame) -> DataFrame:
    """(repo, nine fields): the last known value of each over all files."""
    context = facts.where("kind = 'context'")
    return _wide(merge_last_known(context, ["repo", "name"], ["ordinal", "place"], ["seq"]), ["repo"])


def models(facts: DataFrame, context: DataFrame) -> DataFrame:
    """Distinct models with their provenance.

    A model of a settings file takes all final values of that file, also of
    keys behind it; then every model takes what it doesn't know from the context
    of its repository.
    """
    found = facts.where("kind = 'model'")
    first = keep_first(found, ["repo", "name", "value", "source_file"], ORDER)
    own = facts.where("kind = 'context' AND detector = 'config'").groupBy("repo", "rel_path", "name").agg(F.max_by("value", "seq").alias("value"))
    own = _wide(own, ["repo", "rel_path"]).withColumn("_config", F.lit("config"))
    rows = first.join(own, (first.repo == own.repo) & (first.rel_path == own.rel_path) & (first.detector == own._config), "left")
    rows = rows.select(first.repo, F.col("name").alias("type"), F.col("value").alias("model"), "source_file", F.when(F.col("detector") == "config", "config").alias("source_type"), F.when(F.col("detector") == "config", "medium").alias("confidence"), F.coalesce(X.known("endpoint"), "provider_endpoint").alias("provider_endpoint"), *CONTEXT[1:])
    return fill_from(rows, context, ["repo"], CONTEXT)


def take_stock(files: DataFrame, strict: bool = False, runtime_manifests: bool = True, include_prompts: bool = False, facts: DataFrame | None = None) -> Inventory:
    """All sections of ``files``.  The facts are written once, in folders by
    kind, and every section reads its own kind; pass ``facts`` where they are
    kept in a table already.  A driver that takes stock many times calls
    ``release`` of each inventory that it is done with."""
    work = None
    if facts is None:
        # facts are far fewer than files; rebalancing makes few files of a kind
        found = detect.all_facts(files, strict, runtime_manifests).hint("rebalance", "kind")
        work = Workspace(files.sparkSession, "stock")
        facts = work.save(found, "facts", by=("kind",))
    context = runtime_context(facts)
    entity = lambda kind, *keys: keep_first(facts.where(F.col("kind") == kind), ["repo", *keys], ORDER)
    prompts = entity("prompt", "name").select("repo", F.col("name").alias("id"), "source_file", *([F.col("value").alias("template")] if include_prompts else []))
    return Inventory(
        models=models(facts, context),
        datasets=entity("dataset", "name", "source_file").select("repo", F.col("name").alias("type"), "source_file"),
        tools=entity("tool", "name", "source_file").select("repo", "name", "source_file"),
        prompts=prompts,
        frameworks=facts.where("kind = 'framework'").select("repo", "name").distinct(),
        scan_findings=entity("finding", "name").select("repo", F.col("name").alias("id"), "category", F.col("detector").alias("source_type"), "source_file", "severity", "confidence", F.col("value").alias("evidence")),
        context=context,
        coverage=detect.detector_coverage(facts, files),
        unsupported=detect.unsupported(facts),
        work=work,
    )


def described_entities(stock: Inventory) -> DataFrame:
    """``entities`` with what is known of each: ``model`` and the fields of its
    provenance, for rules whose predicates ask for them; null for others."""
    known = ["model", *CONTEXT]
    models = stock.models.select("repo", F.lit("model").alias("entity_type"), F.col("type").alias("name"), "source_file", *known)
    none = [F.lit(None).cast("string").alias(c) for c in known]
    return models.unionByName(entities(stock).where("entity_type <> 'model'").select("*", *none))


def entities(stock: Inventory) -> DataFrame:
    """Models, tools and, where a repository has prompts, one prompt surface."""
    rows = stock.models.select("repo", F.lit("model").alias("entity_type"), F.col("type").alias("name"), "source_file")
    rows = rows.unionByName(stock.tools.select("repo", F.lit("tool").alias("entity_type"), "name", "source_file"))
    surface = stock.prompts.select("repo").distinct().select("repo", F.lit("prompt_surface").alias("entity_type"), F.lit("prompt_templates").alias("name"), F.lit("").alias("source_file"))
    return rows.unionByName(surface)


def section_counts(stock: Inventory, findings: DataFrame) -> DataFrame:
    """(repo, seven counts)."""
    tables = {"models": stock.models, "tools": stock.tools, "datasets": stock.datasets, "frameworks": stock.frameworks, "prompts": stock.prompts, "unsupported_artifacts": stock.unsupported, "high_or_critical_risks": findings.where(X.is_severe(F.col("severity")))}
    rows = None
    for name, table in tables.items():
        one = table.select("repo", F.lit(name).alias("section"))
        rows = one if rows is None else rows.unionByName(one)
    assert rows is not None
    return rows.groupBy("repo").agg(*[F.count_if(F.col("section") == n).alias(n) for n in tables])


def _provenance() -> Column:
    """The context of a row as a struct, its fields in the order of their names;
    no lineage where all of it is unknown."""
    some = X.any_of([X.known(f).isNotNull() for f in C.LINEAGE_FIELDS])
    lineage = F.when(some, F.struct(*[F.coalesce(f, F.lit(C.UNKNOWN)).alias(f) for f in sorted(C.LINEAGE_FIELDS)]))
    fields = {f: F.coalesce(f, F.lit(C.UNKNOWN)) for f in C.PROVENANCE_FIELDS} | {"lineage": lineage}
    return F.struct(*[fields[f].alias(f) for f in sorted(fields)])


_P = "provenance struct<" + ",".join(f"{f}:string" for f in C.PROVENANCE_FIELDS) + ",lineage:struct<" + ",".join(f"{f}:string" for f in C.LINEAGE_FIELDS) + ">>"
_PROVENANCE = _P.removeprefix("provenance ")
_RISK = "base_rule_id string, category string, confidence string, control_mapping_tags array<string>, control_mappings array<string>, evidence_requirements array<string>, exposure string, heuristic string, id string, owasp_llm string, provenance_completeness string, rationale string, rule_id string, severity string, weighted_score string"
_AS_STRUCT = lambda fields: "array<struct<" + fields.replace(", ", ",").replace(" ", ":") + ">>"
#: the schema of a document, its fields in the order of their names
DOCUMENT = ", ".join(
    [
        "coverage_summary struct<detectors:" + _AS_STRUCT("artifacts_scanned int, artifacts_seen int, default_confidence string, source_type string") + ",unsupported_total:int>",
        "datasets " + _AS_STRUCT("source_file string, type string"),
        "frameworks " + _AS_STRUCT("name string"),
        "metadata struct<artifact_sha256:string,generated_at:string,git_sha:string>",
        f"models array<struct<confidence:string,model:string,provenance:{_PROVENANCE},source_file:string,source_type:string,type:string>>",
        "prompts " + _AS_STRUCT("id string, source_file string, template string"),
        "risk_findings " + _AS_STRUCT(_RISK),
        "risk_policy struct<applied_rules:array<struct<base_rule_id:string,candidate_count:bigint,category:string,control_mappings:array<string>,effective_weights:struct<confidence:double,exposure:double,provenance:double>,enabled:boolean,evidence_requirements:array<string>,post_allowlist_count:bigint,rationale:string,rule_id:string,severity:string,threshold:int>>,policy:struct<policy_id:string,sha256:string,source:string,version:string>,scoring:struct<weights:struct<confidence:double,exposure:double,provenance:double>>,suppressed:array<struct<base_rule_id:string,entity_type:string,name:string,reason:string,rule_id:string,source_file:string>>>",
        f"runtime_context {_PROVENANCE}",
        "scan_findings " + _AS_STRUCT("category string, confidence string, evidence string, id string, severity string, source_file string, source_type string"),
        "schema_version string",
        "source_types " + _AS_STRUCT("default_confidence string, default_severity string, name string"),
        "tools " + _AS_STRUCT("name string, source_file string"),
        "unsupported_artifacts " + _AS_STRUCT("artifact_type string, path string, reason string"),
    ]
)


def _section(rows: DataFrame, name: str, item: Column, key: Column | None = None) -> DataFrame:
    """Items of a section as JSON, and what they are sorted by: ``key``, or the
    spread-out JSON of the item."""
    return rows.select("repo", F.lit(name).alias("section"), F.coalesce(X.ascii_json(F.to_json(item, {"pretty": "true"})) if key is None else key, F.lit("")).alias("key"), F.to_json(item).alias("item"))


def _fields(rows: DataFrame, *without: str) -> Column:
    return F.struct(*[c for c in sorted(rows.columns) if c not in ("repo", *without)])


def documents(stock: Inventory, policy: risk.Policy | None = None, source: dict[str, str] | None = None, generated_at: str = "", commits: DataFrame | None = None) -> DataFrame:
    """(repo, document, sha256): one JSON object for each repository, with all
    sections of ``DOCUMENT``, empty ones too, and its keys sorted.

    ``source`` says where the policy came from (``risk.load_policy``);
    ``generated_at`` is the time of the run and ``commits`` (repo, git_sha) names
    what was scanned.  Lists are sorted as the format wants: coverage by source
    type, frameworks by name, rules and findings by id, others by their text.
    The hash is that of the document without it.  A document holds a
    repository's inventory, not its files; it is one row by the format's nature.
    Sections come in one union and one aggregation."""
    found = risk.evaluate(entities(stock), policy)
    source = source or risk.load_policy(stock.models.sparkSession, None)[1]
    model = F.struct("confidence", "model", _provenance().alias("provenance"), "source_file", "source_type", "type")
    parts = {
        "models": _section(stock.models, "models", model),
        "datasets": _section(stock.datasets, "datasets", _fields(stock.datasets)),
        "tools": _section(stock.tools, "tools", _fields(stock.tools)),
        "prompts": _section(stock.prompts, "prompts", _fields(stock.prompts)),
        "frameworks": _section(stock.frameworks, "frameworks", F.struct("name"), F.col("name")),
        "scan_findings": _section(stock.scan_findings, "scan_findings", _fields(stock.scan_findings)),
        "detectors": _section(stock.coverage, "detectors", _fields(stock.coverage), F.col("source_type")),
        "unsupported_artifacts": _section(stock.unsupported, "unsupported_artifacts", _fields(stock.unsupported), F.concat_ws("\0", X.path_parts("path"))),
        "runtime_context": _section(stock.context, "runtime_context", _provenance()),
        "risk_findings": _section(found.findings, "risk_findings", _fields(found.findings, "entity_type", "name", "source_file"), F.col("id")),
        "applied_rules": _section(found.applied, "applied_rules", _fields(found.applied), F.col("base_rule_id")),
        "suppressed": _section(found.suppressed, "suppressed", _fields(found.suppressed), F.concat_ws("\0", "base_rule_id", "entity_type", "name", "source_file")),
    }
    every = reduce(DataFrame.unionByName, parts.values())
    lists = every.groupBy("repo").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("key", "item")))), lambda x: x["item"]).alias(s) for s in parts])
    if commits is not None:
        lists = lists.join(commits.select("repo", "git_sha"), "repo", "left")
    else:
        lists = lists.withColumn("git_sha", F.lit(None).cast("string"))
    listed = lambda s: F.concat(F.lit("["), F.array_join(s, ","), F.lit("]"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', 1)
    types = F.lit("[" + ",".join(json.dumps({"default_confidence": "high" if s == "python" else "medium", "default_severity": "medium", "name": s}, separators=(",", ":")) for s in C.SOURCE_TYPES) + "]")
    plain = lambda value: F.lit(json.dumps(value, sort_keys=True, separators=(",", ":")))
    context = F.coalesce(F.try_element_at("runtime_context", F.lit(1)), plain(dict.fromkeys(C.PROVENANCE_FIELDS, C.UNKNOWN)))

    def body(meta: list[tuple[str, Column]]) -> Column:
        fields = {
            "coverage_summary": _object([("detectors", listed("detectors")), ("unsupported_total", F.size("unsupported_artifacts").cast("string"))]),
            "metadata": _object(meta),
            "risk_policy": _object([("applied_rules", listed("applied_rules")), ("policy", plain(source)), ("scoring", plain({"weights": found.weights})), ("suppressed", listed("suppressed"))]),
            "runtime_context": context,
            "schema_version": F.lit('"1.0"'),
            "source_types": types,
            **{s: listed(s) for s in ("datasets", "frameworks", "models", "prompts", "risk_findings", "scan_findings", "tools", "unsupported_artifacts")},
        }
        return _object(sorted(fields.items()))

    meta = [("generated_at", quoted(F.lit(generated_at))), ("git_sha", quoted(F.coalesce("git_sha", F.lit(C.UNKNOWN))))]
    out = lists.withColumn("sha256", F.sha2(body(meta), 256))
    return out.select("repo", body([("artifact_sha256", quoted(F.col("sha256"))), *meta]).alias("document"), "sha256")


def _object(fields: list[tuple[str, Column]]) -> Column:
    """A JSON object of fields whose values are JSON already."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), v) for n, v in fields]), F.lit("}"))
