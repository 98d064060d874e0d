"""Exports of an inventory as rows of common formats: packages with references,
components with properties, results, statements.  Each row carries ``repo``; a
sink nests them.  ``vendor`` names the maker in identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake import constants as C
from stocktake.functions import columns as X
from stocktake.operators.inventory import Inventory
from stocktake.operators.relational import keep_first

VENDOR = "stocktake"
_FIELDS = C.PROVENANCE_FIELDS + C.LINEAGE_FIELDS


def parts_of(stock: Inventory) -> DataFrame:
    """(repo, ord, kind, name, version, source_file, fields of provenance) of all
    models, tools, datasets and frameworks."""
    none = {f: F.lit(None).cast("string") for f in _FIELDS}
    row = lambda df, n, kind, name, version, source: df.select("repo", F.lit(n).alias("ord"), F.lit(kind).alias("kind"), F.coalesce(name, F.lit(f"unknown-{kind.lower()}")).alias("name"), F.coalesce(version, F.lit(C.UNKNOWN)).alias("version"), source.alias("source_file"), *[(F.col(f) if f in df.columns else none[f]).alias(f) for f in _FIELDS])
    null = F.lit(None).cast("string")
    out = row(stock.models, 0, "Model", F.col("type"), F.col("model"), F.col("source_file"))
    out = out.unionByName(row(stock.tools, 1, "Tool", F.col("name"), null, F.col("source_file")))
    out = out.unionByName(row(stock.datasets, 2, "Dataset", F.col("type"), null, F.col("source_file")))
    return out.unionByName(row(stock.frameworks, 3, "Framework", F.col("name"), null, null))


def first_finding(findings: DataFrame) -> DataFrame:
    """For each source file its finding with the least id."""
    return keep_first(findings.where("coalesce(source_file, '') <> ''"), ["repo", "source_file"], ["id"])


def _properties(parts: DataFrame, keys: list[str], vendor: str) -> DataFrame:
    """Known fields of provenance, and what the first finding of the source says."""
    cells = [F.struct(F.lit(i).alias("pos"), F.lit(f"{vendor}:{'provenance' if f in C.PROVENANCE_FIELDS else 'lineage'}:{f}").alias("name"), F.col(f).alias("value")) for i, f in enumerate(_FIELDS)]
    cells += [F.struct(F.lit(20 + i).alias("pos"), F.lit(f"{vendor}:detector:{f}").alias("name"), F.col(f"_{f}").alias("value")) for i, f in enumerate(("confidence", "severity", "source_type"))]
    rows = parts.select(*keys, F.explode(F.array(*cells)).alias("p")).where("coalesce(p.value, '') <> ''")
    return rows.select(*keys, "p.pos", "p.name", "p.value")


def spdx(stock: Inventory, risks: DataFrame, vendor: str = VENDOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages, their references and the document's relationships (SPDX 2.3).

    Risks meet packages by equality of the source file; a dependency named in
    the findings meets the first package of that name.
    """
    parts = parts_of(stock).withColumn("spdx_id", X.spdx_id(F.col("kind"), F.col("name"), F.col("version"), F.coalesce("source_file", F.lit(""))))
    packages = parts.select("repo", "spdx_id", "name", F.col("version").alias("version_info"), *[F.lit("NOASSERTION").alias(c) for c in ("download_location", "license_concluded", "license_declared", "supplier")])
    found = first_finding(stock.scan_findings).select("repo", F.col("source_file").alias("_source"), *[F.col(c).alias(f"_{c}") for c in ("confidence", "severity", "source_type")])
    joined = parts.join(found, (parts.repo == found.repo) & (parts.source_file == found._source), "left").drop(found.repo)
    refs = _properties(joined, ["repo", "spdx_id"], vendor).withColumn("category", F.lit("OTHER"))
    sources = parts.where("coalesce(source_file, '') <> ''").select("repo", "spdx_id", F.lit(-1).alias("pos"), F.lit(f"{vendor}-evidence-source").alias("name"), F.concat(F.lit("file:"), "source_file").alias("value"), F.lit("OTHER").alias("category"))
    at = risks.select("repo", F.col("id").alias("_id"), X.risk_source(F.col("id")).alias("_source"))
    keyed = parts.select(F.col("repo").alias("_repo"), "spdx_id", F.coalesce("source_file", F.lit("")).alias("_of"))
    advised = keyed.join(at, (keyed._repo == at.repo) & (keyed._of == at._source)).select("repo", "spdx_id", F.lit(30).alias("pos"), F.lit("advisory").alias("name"), F.concat(F.lit(f"{vendor}-risk:"), "_id").alias("value"), F.lit("SECURITY").alias("category"))
    references = sources.unionByName(refs).unionByName(advised)
    describes = parts.select("repo", F.lit("DESCRIBES").alias("relationship"), F.col("spdx_id").alias("related"))
    depends = dependency_targets(stock, parts, "spdx_id").select("repo", F.lit("DEPENDS_ON").alias("relationship"), F.col("spdx_id").alias("related"))
    return packages, references, describes.unionByName(depends)


def dependency_names(findings: DataFrame) -> DataFrame:
    """(repo, dep) that the evidence of dependency findings lists."""
    listed = findings.where("category = 'dependency graph'").select("repo", F.explode(F.split(F.regexp_extract("evidence", r"(?s)^[^:]*:(.*)$", 1), ",")).alias("dep"))
    return listed.select("repo", F.btrim(F.btrim("dep"), F.lit(".")).alias("dep")).where("dep <> ''").distinct()


def dependency_targets(stock: Inventory, parts: DataFrame, ref: str) -> DataFrame:
    """(repo, dep, ref) of dependencies that are parts; the first part of a name
    counts."""
    order = F.struct("ord", "name", "version", F.coalesce("source_file", F.lit("")))
    named = parts.groupBy("repo", F.lower("name").alias("_low")).agg(F.min_by(ref, order).alias(ref))
    return dependency_names(stock.scan_findings).withColumn("_low", F.lower("dep")).join(named, ["repo", "_low"]).select("repo", "dep", ref)


def cyclonedx(stock: Inventory, risks: DataFrame, vendor: str = VENDOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components, what the document depends on, and vulnerabilities with the
    components that they affect (CycloneDX 1.5)."""
    kinds = F.when(F.col("kind") == "Dataset", "data").when(F.col("kind") == "Framework", "library").otherwise("application")
    parts = parts_of(stock).withColumn("component", kinds)
    parts = parts.withColumn("bom_ref", X.bom_ref(F.col("component"), F.col("name"), F.col("version"), F.col("source_file"), f"{vendor}-"))
    components = parts.select("repo", "bom_ref", F.col("component").alias("type"), "name", "version", F.coalesce("source_file", F.lit(C.UNKNOWN)).alias("source_file"), *_FIELDS)
    depends = dependency_targets(stock, parts, "bom_ref").select("repo", "bom_ref").distinct()
    at = risks.select("repo", "id", "severity", "rationale", "owasp_llm", "rule_id", "base_rule_id", "category", X.risk_source(F.col("id")).alias("_source"))
    keyed = parts.where("coalesce(source_file, '') <> ''").select(F.col("repo").alias("_repo"), F.col("source_file").alias("_of"), F.col("bom_ref").alias("_ref"))
    joined = at.join(keyed, (at.repo == keyed._repo) & (at._source == keyed._of), "left")
    fields = ["repo", "id", "severity", "rationale", "owasp_llm", "rule_id", "base_rule_id", "category"]
    return components, depends, joined.groupBy(*fields).agg(F.sort_array(F.collect_set("_ref")).alias("affects"))


def root_dependencies(depends: DataFrame) -> DataFrame:
    """(repo, depends_on): what each document depends on, distinct and sorted.
    One row is a document's list of its frameworks, tools and models."""
    return depends.groupBy("repo").agg(F.sort_array(F.collect_set("bom_ref")).alias("depends_on"))


def serials(documents: DataFrame, vendor: str = VENDOR) -> DataFrame:
    """(repo, seed, bom_serial, vex_id) from (repo, artifact_sha256, git_sha,
    document): identifiers that stay the same as long as the document does."""
    rows = documents.withColumn("seed", X.stable_seed(F.col("artifact_sha256"), F.col("git_sha"), F.col("document")))
    urn = lambda kind: F.concat(F.lit("urn:uuid:"), X.uuid5(F.concat(F.lit(f"{vendor}:{kind}"), "seed")))
    return rows.select("repo", "seed", urn("").alias("bom_serial"), urn("vex:").alias("vex_id"))


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of an export in the order of its format: packages by ``spdx_id``,
    components by ``bom_ref``, statements and results by id, within each
    repository.  A sort by range, which splits a large repository."""
    return rows.orderBy("repo", *keys)


def sarif(findings: DataFrame, risks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of scan and risk findings, and the first definition of each rule
    (SARIF 2.1.0)."""
    s = findings.select("repo", F.lit(0).alias("ord"), "id", F.concat(F.lit("scan:"), "category").alias("rule_id"), F.col("category").alias("rule_name"), F.col("category").alias("description"), F.lower("severity").alias("level"), F.col("evidence").alias("message"), F.coalesce("source_file", F.lit(C.UNKNOWN)).alias("uri"))
    source = X.risk_source(F.col("id"))
    r = risks.select("repo", F.lit(1).alias("ord"), "id", F.concat(F.lit("risk:"), "rule_id").alias("rule_id"), F.col("rule_id").alias("rule_name"), F.col("owasp_llm").alias("description"), F.lower("severity").alias("level"), F.col("rationale").alias("message"), F.when(source == "", "risk-policy").otherwise(source).alias("uri"))
    both = s.unionByName(r)
    rules = keep_first(both.select("repo", "rule_id", "rule_name", "description", "ord", "id"), ["repo", "rule_id"], ["ord", "id"]).drop("ord", "id")
    return both.select("repo", "ord", "id", "rule_id", "level", "message", "uri"), rules


def vex(risks: DataFrame) -> DataFrame:
    """Statements of risk findings (OpenVEX 0.2.0)."""
    source = X.risk_source(F.col("id"))
    product = F.concat(F.lit("file:"), F.when(source == "", C.UNKNOWN).otherwise(source))
    return risks.select("repo", F.col("id").alias("vulnerability"), product.alias("product"), X.vex_status(F.col("severity")).alias("status"), F.col("owasp_llm").alias("justification"), F.col("rationale").alias("impact_statement"), F.lit("Review mitigation and compensating controls.").alias("action_statement"))


def manifest(files: DataFrame, name: Column, content: Column) -> DataFrame:
    """(name, sha256) of the files of an evidence bundle."""
    return files.select(name.alias("name"), F.sha2(content, 256).alias("sha256"))
