"""Profiles of inventories and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake import constants as C
from stocktake.functions import columns as X
from stocktake.operators.relational import top_of_each


def top_risks(risks: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` gravest findings of each repository, then by score and id."""
    order = [X.severity_rank(F.col("severity")), F.desc(F.col("weighted_score").cast("double")), F.col("id")]
    return top_of_each(risks, ["repo"], order, n).select("repo", "rank", "id", "severity", "weighted_score", "rationale")


def profile(counts: DataFrame, risks: DataFrame, n: int = 3) -> DataFrame:
    """(repo, counts, top_risks): one row for each repository."""
    top = top_risks(risks, n).groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("rank", "severity", "id"))).alias("top_risks"))
    return counts.join(top, "repo", "left")


def ai_profile(documents: DataFrame, n: int = 3) -> DataFrame:
    """The profile of each document (repo, document: a struct of
    ``inventory.DOCUMENT``): repo, schema_version, metadata, executive_summary,
    ai_assets (models with their provider, tools, datasets, frameworks, each
    sorted), risk_highlights (the ``n`` gravest findings, then by score and id),
    provenance_and_compliance and detector_coverage.

    All are expressions over one row, so nothing is shuffled.  Sections that a
    document lacks are empty, values that an item lacks are ``unknown``.  A
    finding without a score has 0.0, one without a title the empty text."""
    d = lambda c: F.col(f"document.{c}")
    size = lambda c: F.coalesce(F.size(d(c)), F.lit(0))
    listed = lambda c: F.coalesce(d(c), F.array().cast(documents.schema["document"].dataType[c].dataType))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(C.UNKNOWN))
    severity = lambda x: F.coalesce(x["severity"], F.lit(""))
    findings = listed("risk_findings")
    counts = [size(c).alias(c) for c in ("models", "tools", "datasets", "frameworks", "prompts", "risk_findings")]
    severe = F.size(F.filter(findings, lambda x: X.is_severe(severity(x))))
    assets = F.struct(
        F.array_sort(F.transform(listed("models"), lambda m: F.struct(text(m["type"]).alias("type"), text(m["model"]).alias("model"), text(m["source_file"]).alias("source_file"), text(m["provenance"]["provider_endpoint"]).alias("provider")))).alias("models"),
        F.array_sort(F.transform(listed("tools"), lambda t: F.struct(text(t["name"]).alias("name"), text(t["source_file"]).alias("source_file")))).alias("tools"),
        F.array_sort(F.transform(listed("datasets"), lambda t: F.struct(text(t["type"]).alias("type"), text(t["source_file"]).alias("source_file")))).alias("datasets"),
        F.array_sort(F.transform(listed("frameworks"), lambda t: F.coalesce(t["name"], F.lit("")))).alias("frameworks"),
    )
    ranked = F.array_sort(F.transform(findings, lambda r: F.struct(X.severity_rank(severity(r)).alias("rank"), F.coalesce(r["id"], F.lit("")).alias("id"), severity(r).alias("severity"), F.coalesce(r["rule_id"], F.lit("")).alias("rule_id"))))
    gravest = F.transform(F.slice(ranked, 1, n), lambda r: F.struct(r["id"].alias("id"), F.lit("").alias("title"), r["severity"].alias("severity"), F.lit(0.0).alias("score"), r["rule_id"].alias("rule_id")))
    detectors = F.array_sort(F.transform(F.coalesce(d("coverage_summary.detectors"), F.array().cast("array<struct<artifacts_scanned:int,artifacts_seen:int,default_confidence:string,source_type:string>>")), lambda x: F.struct(text(x["source_type"]).alias("source_type"), F.coalesce(x["artifacts_seen"], F.lit(0)).alias("artifacts_seen"), F.coalesce(x["artifacts_scanned"], F.lit(0)).alias("artifacts_scanned"))))
    return documents.select(
        "repo",
        F.coalesce(d("schema_version"), F.lit("1.0")).alias("schema_version"),
        d("metadata").alias("metadata"),
        F.struct(*counts, severe.alias("high_or_critical_risks"), size("unsupported_artifacts").alias("unsupported_artifacts")).alias("executive_summary"),
        assets.alias("ai_assets"),
        gravest.alias("risk_highlights"),
        F.struct(d("runtime_context").alias("runtime_context"), d("risk_policy").alias("risk_policy"), d("source_types").alias("source_types")).alias("provenance_and_compliance"),
        F.struct(F.coalesce(d("coverage_summary.unsupported_total"), F.lit(0)).alias("unsupported_total"), detectors.alias("detectors")).alias("detector_coverage"),
    )


def text_summary(profiles: DataFrame) -> DataFrame:
    """(repo, text): the profile in lines."""
    names = [c for c in profiles.columns if c not in ("repo", "top_risks")]
    rows = [F.concat(F.lit(f"{c.replace('_', ' ')}: "), F.col(c).cast("string")) for c in names]
    risks = F.transform("top_risks", lambda r: F.concat(F.lit("- ["), r["severity"], F.lit("] "), r["id"]))
    return profiles.select("repo", F.concat_ws("\n", F.concat(F.lit("inventory of "), "repo"), *rows, risks).alias("text"))


def markdown_summary(summary: DataFrame) -> DataFrame:
    """(repo, line): a row of a markdown table for each repository."""
    names = [c for c in summary.columns if c != "repo"]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names]
    return summary.select("repo", F.concat(F.lit("| "), F.concat_ws(" | ", "repo", *cells), F.lit(" |")).alias("line"))
