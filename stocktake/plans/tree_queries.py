"""Queries of source trees: files made from ``part`` are written as the trees of
their brands, some brands have none, and all are listed, read and scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.operators import drift, inventory, risk
from stocktake.plans.inventory_queries import _FOUND
from stocktake.plans.registry import Registry, registered, table
from stocktake.plans.source_queries import part_contents
from stocktake.sources import tree
from stocktake.sources.work import Workspace

QUERIES: Registry = {}

#: brands whose name ends so have no tree
_GONE = "3"
_MISSING = "No such file or directory"


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tree.Trees]:
    """Repositories, and what their trees hold."""
    place = Workspace(spark, "source").path("trees")
    folder = place.removeprefix("file:").replace("//", "/")
    made = part_contents(spark, sf_dir)
    tree.write_trees(made.where(~F.col("repo").endswith(_GONE)), folder)
    repos = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo")).distinct()
    return repos, tree.list_trees(repos.withColumn("root", F.concat(F.lit(f"{folder}/"), "repo")))


@registered(
    QUERIES,
    f"""SELECT p_brand AS repo, CASE WHEN suffix(p_brand, '{_GONE}') THEN 'error' ELSE 'ok' END AS status, CASE WHEN suffix(p_brand, '{_GONE}') THEN '{_MISSING}' END AS error,
  CASE WHEN NOT suffix(p_brand, '{_GONE}') THEN count(*)::BIGINT END AS files FROM part GROUP BY p_brand""",
)
def failed_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories without a tree are rows, not a failed job."""
    repos, found = _trees(spark, sf_dir)
    counts = found.files.groupBy("repo").agg(F.count("*").alias("files"))
    errors = found.errors.where("rel_path = ''").select("repo", F.col("error").alias("reason"))
    return drift.repo_summary(repos, counts, errors).select("repo", "status", "error", "files")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos, found = _trees(spark, sf_dir)
    stock = inventory.take_stock(tree.files_of(tree.contents(found.files)))
    counts = inventory.section_counts(stock, risk.evaluate(inventory.entities(stock)).findings)
    errors = found.errors.where("rel_path = ''").select("repo", F.col("error").alias("reason"))
    return drift.scan_summary(repos, counts, errors, drift.scan_gates(counts, max_high_risk=4, max_unsupported=0))


_SUMMED = f"""{_FOUND}, s AS (SELECT repo, suffix(repo, '{_GONE}') AS gone, CASE WHEN suffix(repo, '{_GONE}') THEN 0 ELSE models END AS models, 0 AS tools, 0 AS datasets, CASE WHEN suffix(repo, '{_GONE}') THEN 0 ELSE frameworks END AS frameworks,
  0 AS prompts, 0 AS unsupported_artifacts, CASE WHEN suffix(repo, '{_GONE}') THEN 0 ELSE high_or_critical_risks END AS high_or_critical_risks FROM counts),
v AS (SELECT *, CASE WHEN gone THEN 'scan-error' WHEN high_or_critical_risks > 4 THEN 'max-high-risk' END AS failure FROM s)"""


@registered(
    QUERIES,
    f"""WITH {_SUMMED} SELECT repo, CASE WHEN gone THEN 'error' ELSE 'ok' END AS status, CASE WHEN gone THEN '{_MISSING}' END AS error, models::BIGINT AS models, tools::BIGINT AS tools, datasets::BIGINT AS datasets, frameworks::BIGINT AS frameworks,
  prompts::BIGINT AS prompts, unsupported_artifacts::BIGINT AS unsupported_artifacts, high_or_critical_risks::BIGINT AS high_or_critical_risks, CASE WHEN failure IS NULL THEN 'pass' ELSE 'fail' END AS gate_verdict, coalesce(failure, '') AS gate_failures FROM v""",
)
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repository with its counts, its verdict and the gates that failed."""
    return _summary(spark, sf_dir).withColumn("gate_failures", F.array_join("gate_failures", ","))


@registered(
    QUERIES,
    f"""WITH {_SUMMED}, c AS (SELECT left(repo, 7) AS organisation, repo, failure, section, n FROM v UNPIVOT (n FOR section IN (models, tools, datasets, frameworks, prompts, unsupported_artifacts, high_or_critical_risks)))
SELECT organisation, section, CASE WHEN grouping(organisation) = 1 THEN 'all' WHEN grouping(section) = 1 THEN 'organisation' ELSE 'section' END AS level, count(DISTINCT repo)::BIGINT AS repositories,
  count(DISTINCT CASE WHEN failure IS NOT NULL THEN repo END)::BIGINT AS failed, sum(n)::BIGINT AS total, CASE WHEN count(failure) > 0 THEN 'fail' ELSE 'pass' END AS gate_verdict
FROM c GROUP BY GROUPING SETS ((organisation, section), (organisation), ())""",
)
def scan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by organisation (the brand's first digit) and section."""
    return drift.rollup(_summary(spark, sf_dir), F.substring("repo", 1, 7))


@registered(
    QUERIES,
    f"SELECT p_brand AS repo, '' AS rel_path, '{_MISSING}' AS error FROM part WHERE suffix(p_brand, '{_GONE}') GROUP BY p_brand",
)
def unreadable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots, folders and files that could not be read, and why."""
    return _trees(spark, sf_dir)[1].errors
