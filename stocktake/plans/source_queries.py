"""Queries of the detectors and the inventory, over source files that are made
from the rows of ``part``: one small file for each part, of seven kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.operators import detect, export, inventory, report, risk
from stocktake.plans.registry import Registry, registered, table
from stocktake.sources.tree import files_of

QUERIES: Registry = {}

# path and text of each kind; {n} is the part's name, {k} its key, {s} its size
_KINDS = [
    ("src/p{k}.py", 'from openai import OpenAI\nm = OpenAI(model="{n}")\n'),
    ("src/p{k}.java", 'import com.openai.Client;\nvar m = new OpenAiChatModel("{n}");\n'),
    ("src/p{k}.go", 'c := openai.NewClient("{n}")\n'),
    ("src/p{k}.cs", 'var c = new AnthropicClient("{n}");\n'),
    ("src/p{k}.ts", 'import {{ ChatOpenAI }} from "@langchain/openai";\nconst m = new ChatOpenAI({{ model: "{n}" }});\n'),
    ("src/p{k}.yaml", "model: {n}\nregion: r{s}\nprovider: openai\n"),
    ("p{k}/requirements.txt", "openai>=1\nzz{k}\n"),
]


def part_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, rel_path, content)."""
    part = table(spark, sf_dir, "part")
    values = {"n": F.col("p_name"), "k": F.col("p_partkey").cast("string"), "s": F.col("p_size").cast("string")}

    def filled(template: str):  # noqa: ANN202
        marked = template.format(n="\0n\0", k="\0k\0", s="\0s\0").split("\0")
        return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(marked)])

    pick = F.array(*[F.struct(filled(path).alias("rel_path"), filled(text).cast("binary").alias("content")) for path, text in _KINDS])
    # the table is one small split, parsing its files is the work: deal them out
    part = part.repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    rows = part.select(F.col("p_brand").alias("repo"), F.element_at(pick, (F.col("p_partkey") % len(_KINDS) + 1).cast("int")).alias("f"))
    return rows.select("repo", "f.rel_path", "f.content")


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(part_contents(spark, sf_dir))


# path and text of each kind; {k} is the part's key
_TOOLS = [
    ("t{k}.java", 'ToolSpecification find{k}(x)\nvar p = new PromptTemplate("template {k}");\n'),
    ("t{k}.go", 'search{k} := tools.Search()\np := PromptTemplate("template {k}")\n'),
    ("t{k}.cs", 'find{k} = KernelFunction()\nvar p = new PromptTemplateConfig("template {k}");\n'),
    ("t{k}.ts", 'import {{ tool, PromptTemplate }} from "langchain";\nconst t = tool(x);\nconst p = PromptTemplate("template {k}");\n'),
]


_TOOLED = "m AS (SELECT p_brand AS repo, p_partkey AS k, p_partkey % 4 AS kind, 't' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.java' WHEN 1 THEN '.go' WHEN 2 THEN '.cs' ELSE '.ts' END AS path FROM part)"


def tool_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with a tool and a prompt for each part, in four languages."""
    part = table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    key = F.col("p_partkey").cast("string")

    def filled(text: str):  # noqa: ANN202
        marked = text.format(k="\0").split("\0")
        return F.concat(*[c for i, x in enumerate(marked) for c in ([key] if i else []) + [F.lit(x)]])

    pick = F.array(*[F.struct(filled(path).alias("rel_path"), filled(text).cast("binary").alias("content")) for path, text in _TOOLS])
    rows = part.select(F.col("p_brand").alias("repo"), F.element_at(pick, (F.col("p_partkey") % 4 + 1).cast("int")).alias("f"))
    return files_of(rows.select("repo", "f.rel_path", "f.content"))


_MADE = "m AS (SELECT p_brand AS repo, p_partkey AS k, p_partkey % 7 AS kind, p_name AS n, 'r' || p_size AS region FROM part), ctx AS (SELECT repo, arg_max(region, 'src/p' || k || '.yaml') AS region FROM m WHERE kind = 5 GROUP BY repo)"


@registered(
    QUERIES,
    f"""WITH {_MADE}, found AS (SELECT m.*, CASE kind WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'OpenAI' WHEN 2 THEN 'OpenAI' WHEN 3 THEN 'Anthropic' WHEN 4 THEN 'ChatOpenAI' ELSE 'ConfigModelHint' END AS type,
  'src/p' || k || CASE kind WHEN 0 THEN '.py' WHEN 1 THEN '.java:2' WHEN 2 THEN '.go:1' WHEN 3 THEN '.cs:1' WHEN 4 THEN '.ts:2' ELSE '.yaml' END AS source_file,
  CASE kind WHEN 3 THEN 'https://api.anthropic.com' WHEN 5 THEN 'unknown' ELSE 'https://api.openai.com' END AS provider_endpoint FROM m WHERE kind < 6)
SELECT f.repo, type, n AS model, source_file, provider_endpoint, CASE WHEN kind = 5 THEN f.region ELSE coalesce(ctx.region, 'unknown') END AS region FROM found f LEFT JOIN ctx ON f.repo = ctx.repo""",
)
def inventory_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.take_stock(part_files(spark, sf_dir)).models.select("repo", "type", "model", "source_file", "provider_endpoint", "region")


@registered(
    QUERIES,
    f"""WITH {_MADE}, f AS (SELECT repo, CASE WHEN kind = 0 THEN 'python' WHEN kind = 1 THEN 'java_ast' WHEN kind = 2 THEN 'go_ast' WHEN kind = 3 THEN 'dotnet_ast' WHEN kind = 4 THEN 'js_ts_ast' WHEN kind = 5 THEN 'config' ELSE 'runtime_manifest' END AS detector, kind FROM m),
n AS (SELECT detector, 'model' AS kind, count(*) AS n FROM f WHERE kind < 6 GROUP BY ALL
UNION ALL SELECT detector, 'finding', sum(CASE WHEN kind = 5 THEN 2 ELSE 1 END) FROM f GROUP BY ALL
UNION ALL SELECT detector, 'framework', count(*) FROM f WHERE kind IN (0, 1, 4, 5, 6) GROUP BY ALL
UNION ALL SELECT detector, 'context', count(*) FROM f WHERE kind = 5 GROUP BY ALL)
SELECT detector, kind, n::BIGINT AS n FROM n""",
)
def detected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.all_facts(part_files(spark, sf_dir)).where("kind <> 'file'").groupBy("detector", "kind").agg(F.count("*").alias("n"))


@registered(
    QUERIES,
    f"""WITH {_MADE} SELECT DISTINCT repo, CASE WHEN kind = 4 THEN 'langchain' ELSE 'openai' END AS name FROM m WHERE kind IN (0, 1, 4, 5, 6)""",
)
def inventory_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.all_facts(part_files(spark, sf_dir)).where("kind = 'framework'").select("repo", "name").distinct()


@registered(
    QUERIES,
    f"""WITH {_MADE} SELECT repo, 'runtime-deps:p' || k || '/requirements.txt' AS id, 'Detected dependencies: openai, zz' || k AS evidence FROM m WHERE kind = 6""",
)
def manifest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = detect.scan(part_files(spark, sf_dir), only=["runtime_manifest"])
    return facts.where("kind = 'finding'").select("repo", F.col("name").alias("id"), F.col("value").alias("evidence"))


@registered(
    QUERIES,
    f"""WITH {_MADE}, t(source_type, kind) AS (VALUES ('python', 0), ('jupyter_notebook', -1), ('config', 5), ('runtime_manifest', 6), ('js_ts_manifest', -1), ('js_ts_ast', 4), ('java_ast', 1), ('go_ast', 2), ('dotnet_ast', 3))
SELECT r.repo, t.source_type, count(m.k)::INTEGER AS artifacts_seen, count(m.k)::INTEGER AS artifacts_scanned, 'medium' AS default_confidence FROM (SELECT DISTINCT repo FROM m) r CROSS JOIN t LEFT JOIN m ON m.repo = r.repo AND m.kind = t.kind GROUP BY r.repo, t.source_type""",
)
def detector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detector_coverage(detect.all_facts(part_files(spark, sf_dir)))


@registered(
    QUERIES,
    f"""WITH {_MADE}, r AS (SELECT repo, 'third-party-provider:' || CASE kind WHEN 4 THEN 'ChatOpenAI' ELSE 'OpenAI' END || ':src/p' || k || CASE kind WHEN 0 THEN '.py' WHEN 1 THEN '.java:2' WHEN 2 THEN '.go:1' ELSE '.ts:2' END AS id FROM m WHERE kind IN (0, 1, 2, 4)),
n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS rank FROM r)
SELECT repo, rank::INTEGER AS rank, id, 'critical' AS severity, '0.810' AS weighted_score FROM n WHERE rank <= 3""",
)
def inventory_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = inventory.take_stock(part_files(spark, sf_dir))
    found = risk.evaluate(inventory.entities(stock)).findings
    return report.top_risks(found).select("repo", "rank", "id", "severity", "weighted_score")


@registered(
    QUERIES,
    f"""WITH {_MADE} SELECT repo, 'DEPENDS_ON' AS relationship, count(*)::BIGINT AS n FROM (SELECT DISTINCT repo FROM m WHERE kind = 6) WHERE repo IN (SELECT repo FROM m WHERE kind IN (0, 1, 2, 5, 6)) GROUP BY repo
UNION ALL SELECT repo, 'DESCRIBES', (count(*) FILTER (WHERE kind < 6) + max(CASE WHEN kind = 4 THEN 1 ELSE 0 END) + max(CASE WHEN kind IN (0, 1, 5, 6) THEN 1 ELSE 0 END))::BIGINT FROM m GROUP BY repo""",
)
def spdx_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = inventory.take_stock(part_files(spark, sf_dir))
    none = spark.createDataFrame([], "repo string, id string")
    return export.spdx(stock, none)[2].groupBy("repo", "relationship").agg(F.count("*").alias("n"))


@registered(QUERIES)
def inventory_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of each repository; its parts are checked by the queries above."""
    return inventory.documents(inventory.take_stock(part_files(spark, sf_dir)))
