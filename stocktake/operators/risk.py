"""Risk rules over entities (repo, entity_type, name, source_file), by policy.

A rule is a predicate over the columns of an entity; the built-in ones ask for an
entity type and some names.  All rules are evaluated as one array in one pass
over the entities, so a rule more is an expression more and no join.  A policy may rename or disable a rule, set its severity,
threshold and weights, and list exceptions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake import constants as C
from stocktake.functions import columns as X
from stocktake.operators.relational import match_exceptions

Policy = dict[str, object]


def normal_weights(given: object) -> dict[str, float]:
    """Weights that sum to one; what is missing or no number is the default."""
    given = given if isinstance(given, dict) else {}
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    weights = {k: float(given[k]) if number(given.get(k)) else d for k, d in C.WEIGHTS.items()}
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else dict(C.WEIGHTS)


def load_policy(spark: SparkSession, path: str | None) -> tuple[Policy, dict[str, str]]:
    """A policy file (JSON), read through Spark, and where it came from."""
    if path is None:
        policy: Policy = {"policy_id": "builtin-default", "version": "1", "rule_overrides": {}}
        text, source = json.dumps(policy, sort_keys=True, separators=(",", ":")), "builtin"
    else:
        if not path.endswith(".json"):
            raise ValueError("a policy file ends in .json")
        text, source = spark.read.text(path, wholetext=True).first().value, path
        policy = json.loads(text)
        if not isinstance(policy, dict):
            raise ValueError("a policy is an object")
    digest = hashlib.sha256(text.encode()).hexdigest()
    return policy, {"policy_id": str(policy.get("policy_id", "unknown")), "version": str(policy.get("version", "unknown")), "source": source, "sha256": digest}


@dataclass
class Evaluation:
    """``findings`` and what the policy did: ``applied`` rules and ``suppressed``
    entities or rules."""

    findings: DataFrame
    applied: DataFrame
    suppressed: DataFrame
    weights: dict[str, float]  # global ones of the policy; they explain, but never change a score


def _rule_rows(spark: SparkSession, policy: Policy, more: Sequence[dict]) -> tuple[DataFrame, DataFrame]:
    """Rules with their overrides; exceptions by rule."""
    overrides = policy.get("rule_overrides")
    overrides = overrides if isinstance(overrides, dict) else {}
    rules, exceptions = [], []
    for rule in [*C.RULES, *more]:
        base = rule["base_rule_id"]
        own = overrides.get(base)
        own = own if isinstance(own, dict) else {}
        w = normal_weights(own.get("weights"))
        tags = own.get("control_mapping_tags")
        severity = own.get("severity")
        rules.append((base, str(own.get("rule_id", base)), own.get("enabled") is not False, int(own.get("threshold", 1)), None if severity is None else str(severity), rule["category"], rule["owasp_llm"], rule["default_severity"], rule["rationale"], rule["confidence"], rule["exposure"], rule["with_source"], rule["without_source"], w["confidence"], w["exposure"], w["provenance"], rule["control_mappings"], [str(t) for t in tags] if isinstance(tags, list) else [], rule["evidence_requirements"]))
        listed = own.get("allowlist")
        for pos, item in enumerate(listed if isinstance(listed, list) else []):
            text = {f: str(item.get(f, "")).strip() for f in ("entity_type", "name", "source_file")}
            exceptions.append((base, text["entity_type"], text["name"], text["source_file"], pos, str(item.get("reason", "allowlisted"))))
    schema = "base_rule_id string, rule_id string, enabled boolean, threshold int, set_severity string, category string, owasp_llm string, default_severity string, rationale string, c double, e double, with_source double, without_source double, wc double, we double, wp double, control_mappings array<string>, control_mapping_tags array<string>, evidence_requirements array<string>"
    return spark.createDataFrame(rules, schema), spark.createDataFrame(exceptions, "base_rule_id string, entity_type string, name string, source_file string, pos int, reason string")


def predicate(rule: dict) -> Column:
    """When a rule speaks of an entity: ``when``, a column or its SQL text, or its
    ``entity_type`` and ``names``.  Null counts as no."""
    when = rule.get("when")
    if when is None:
        found = (F.col("entity_type") == rule["entity_type"]) & F.col("name").isin(rule["names"])
    else:
        found = F.expr(when) if isinstance(when, str) else when
    return F.coalesce(found, F.lit(False))


def weighted_score(rows: DataFrame) -> DataFrame:
    """``rows`` (c, e, p, wc, we, wp) with ``score``."""
    return rows.withColumn("score", F.col("c") * F.col("wc") + F.col("e") * F.col("we") + F.col("p") * F.col("wp"))


def evaluate(entities: DataFrame, policy: Policy | None = None, more: Sequence[dict] = ()) -> Evaluation:
    """Risk findings of ``entities``, by repository; ``more`` rules may stand
    beside the built-in ones, with the same fields or with a ``when`` over any
    column of ``entities`` in place of ``entity_type`` and ``names``.

    Null names are ``unknown``, null sources empty.  Repeated entities give
    repeated findings.  An empty table gives no findings, and each enabled rule
    of each repository it names is listed as applied.
    """
    spark = entities.sparkSession
    rules, exceptions = _rule_rows(spark, policy or {}, more)
    clean = entities.withColumns({"name": F.coalesce("name", F.lit(C.UNKNOWN)), "source_file": F.coalesce("source_file", F.lit(""))})
    # one pass: the rules that speak of each entity, as an array of their names
    hits = F.array_compact(F.array(*[F.when(predicate(rule), F.lit(rule["base_rule_id"])) for rule in [*C.RULES, *more]]))
    matches = clean.select("repo", "entity_type", "name", "source_file", F.explode(hits).alias("base_rule_id"))
    # what a rule says is a constant: a bounded side
    matches = matches.join(F.broadcast(rules.where("enabled")), "base_rule_id")
    matches = match_exceptions(matches, exceptions, ["base_rule_id", "entity_type", "name", "source_file"])
    counted = matches.groupBy("repo", "base_rule_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("reason").isNull()).alias("kept"))
    bases = F.explode(F.array(*[F.lit(r["base_rule_id"]) for r in [*C.RULES, *more]])).alias("base_rule_id")
    repos = entities.select("repo").distinct().select("repo", bases)
    every = repos.join(F.broadcast(rules), "base_rule_id").join(counted, ["repo", "base_rule_id"], "left").na.fill(0, ["candidates", "kept"])
    open_rules = every.where("enabled AND kept >= threshold").select("repo", "base_rule_id")
    p = F.when(F.col("source_file") != "", F.col("with_source")).otherwise(F.col("without_source"))
    scored = weighted_score(matches.where("reason IS NULL").withColumn("p", p).join(open_rules, ["repo", "base_rule_id"], "left_semi"))
    number = lambda c, n: F.format_string(f"%.{n}f", c)
    findings = scored.select(
        "repo",
        F.concat_ws(":", "rule_id", "name", "source_file").alias("id"),
        "rule_id",
        "base_rule_id",
        "category",
        "owasp_llm",
        F.coalesce("set_severity", X.severity_of(F.col("score"))).alias("severity"),
        "rationale",
        F.lit("true").alias("heuristic"),
        number("c", 2).alias("confidence"),
        number("e", 2).alias("exposure"),
        number("p", 2).alias("provenance_completeness"),
        number("score", 3).alias("weighted_score"),
        "control_mappings",
        "control_mapping_tags",
        "evidence_requirements",
        "entity_type",
        "name",
        "source_file",
    )
    applied = every.where("enabled").select("repo", "base_rule_id", "rule_id", F.coalesce("set_severity", "default_severity").alias("severity"), "threshold", F.col("candidates").alias("candidate_count"), F.col("kept").alias("post_allowlist_count"), "enabled", "category", "rationale", "evidence_requirements", "control_mappings", F.struct(F.col("wc").alias("confidence"), F.col("we").alias("exposure"), F.col("wp").alias("provenance")).alias("effective_weights"))
    excepted = matches.where("reason IS NOT NULL").select("repo", "base_rule_id", "rule_id", "entity_type", "name", "source_file", "reason")
    few = F.concat(F.lit("threshold-not-met: "), F.col("kept").cast("string"), F.lit(" < "), F.col("threshold").cast("string"))
    closed = every.where("NOT enabled OR kept < threshold").select("repo", "base_rule_id", "rule_id", F.lit("rule").alias("entity_type"), F.col("base_rule_id").alias("name"), F.lit("").alias("source_file"), F.when(F.col("enabled"), few).otherwise("disabled-by-policy").alias("reason"))
    scoring = (policy or {}).get("scoring")
    weights = normal_weights(scoring.get("weights") if isinstance(scoring, dict) else None)
    return Evaluation(findings, applied, excepted.unionByName(closed), weights)
