"""A whole small project, its document, references and profile."""

import json

import pytest
from pyspark.sql import functions as F

from stocktake.operators import export, inventory, report, risk
from stocktake.sources.history import read_documents, write_documents
from stocktake.sources.tree import license_report, read_trees

PROJECT = {
    "app.py": 'from langchain.chat_models import ChatOpenAI\nfrom langchain.vectorstores import FAISS\nfrom langchain.agents import initialize_agent\nfrom langchain.prompts import PromptTemplate\n\nllm = ChatOpenAI(model="gpt-4o-mini")\nstore = FAISS.from_texts([])\nagent = initialize_agent([], llm)\nprompt = PromptTemplate("Answer: {q}")\n',
    "alias_wrappers.py": 'from langchain.chat_models import ChatOpenAI as Chat\nfrom langchain.agents import initialize_agent as start\n\nMake = Chat\nfirst = Make(model="gpt-4.1-mini")\nsecond = Chat()\nagent = start([], first)\n',
    "demo.ipynb": json.dumps({"cells": [{"cell_type": "code", "source": ["from langchain.chat_models import ChatOpenAI\n", 'llm = ChatOpenAI(model="gpt-4o-mini")']}]}),
    ".env": "OPENAI_API_KEY=sk-test-value\nANTHROPIC_API_KEY=anth-test\n",
    "settings.yaml": "model: gpt-4.1-mini\nprovider: openai\n",
    "package.json": json.dumps({"dependencies": {"langchain": "^0.1", "openai": "^4"}}),
    "requirements.txt": "anthropic==0.3\nlangchain>=0.1\n",
    "Dockerfile": "FROM python:3.11-slim\nRUN true\n",
    "script.ts": 'import OpenAI from "openai";\nimport { tool, PromptTemplate } from "langchain";\n\n\nconst client = new OpenAI({ model: "gpt-4o" });\nconst t = tool(x);\nconst p = PromptTemplate("Say something: {x}");\n',
    "edge_cases.ts": 'import { ChatOpenAI } from "@langchain/openai";\nimport { tool, PromptTemplate } from "langchain";\n\n\n\nconst m = new ChatOpenAI({ modelName: "other key" });\nconst t = tool(x);\nconst p = PromptTemplate("Another template");\n',
    "assistant.java": 'var model = new OpenAiChatModel("gpt-4o");\nToolSpecification spec;\nvar p = new PromptTemplate("Hello there");\n',
    "assistant.go": 'import "github.com/openai/openai-go"\nc := openai.NewClient("sk-local")\nrun := tool.Run()\np := PromptTemplate("Hello there")\n',
    "Assistant.cs": 'using OpenAI;\nvar c = new OpenAIClient("sk-local");\nvar t = KernelFunction();\nvar p = new PromptTemplateConfig("Hello there");\n',
}


@pytest.fixture(scope="module")
def stock(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in PROJECT.items():
        (root / name).write_text(text)
    return inventory.take_stock(read_trees(spark, {"p": str(root)}))


@pytest.fixture(scope="module")
def document(spark, stock, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('docs')}/documents"
    made = inventory.documents(stock, generated_at="20250101T010203Z")
    write_documents(made, path)
    return json.loads(made.first().document), read_documents(spark, path, inventory.DOCUMENT)


def test_document_of_the_whole_project(document):
    found = document[0]
    seen = {d["source_type"]: (d["artifacts_seen"], d["artifacts_scanned"]) for d in found["coverage_summary"]["detectors"]}
    assert seen == {"config": (3, 3), "dotnet_ast": (1, 1), "go_ast": (1, 1), "java_ast": (1, 1), "js_ts_ast": (2, 2), "js_ts_manifest": (1, 1), "jupyter_notebook": (1, 1), "python": (2, 2), "runtime_manifest": (2, 2)}
    assert {(m["type"], m["model"], m["source_file"]) for m in found["models"]} == {
        ("ChatOpenAI", "gpt-4o-mini", "app.py"),
        ("ChatOpenAI", "gpt-4.1-mini", "alias_wrappers.py"),
        ("ChatOpenAI", "unknown", "alias_wrappers.py"),
        ("ChatOpenAI", "gpt-4o-mini", "demo.ipynb#cell-0"),
        ("ConfigModelHint", "gpt-4.1-mini", "settings.yaml"),
        ("OpenAI", "gpt-4o", "script.ts:5"),
        ("ChatOpenAI", "unknown", "edge_cases.ts:6"),
        ("OpenAI", "gpt-4o", "assistant.java:1"),
        ("OpenAI", "sk-local", "assistant.go:2"),
        ("OpenAI", "sk-local", "Assistant.cs:2"),
    }
    assert {(t["name"], t["source_file"]) for t in found["tools"]} >= {("initialize_agent", "app.py"), ("initialize_agent", "alias_wrappers.py"), ("tool", "script.ts:6"), ("tool", "edge_cases.ts:7"), ("java_tool", "assistant.java:2")}
    assert {p["id"] for p in found["prompts"]} == {"app.py:9", "script.ts:7", "edge_cases.ts:8", "assistant.java:3", "assistant.go:4", "Assistant.cs:4"}
    assert found["datasets"] == [{"source_file": "app.py", "type": "langchain.vectorstores.FAISS.from_texts"}]
    keys = {f["evidence"] for f in found["scan_findings"] if f["category"] == "provider credential"}
    assert keys == {"OPENAI_API_KEY=[masked:sk*********ue hash:928d882b4239]", "ANTHROPIC_API_KEY=[masked:an*****st hash:25e2f144a82b]"}
    assert found["runtime_context"]["immutable_version"] == "python:3.11-slim"


def test_references_of_packages_and_their_risks(stock):
    risks = risk.evaluate(inventory.entities(stock)).findings
    packages, references, relationships = export.spdx(stock, risks, vendor="v")
    names = {r.spdx_id: (r.name, r.version_info) for r in packages.collect()}
    found = {}
    for r in references.collect():
        found.setdefault(names[r.spdx_id], set()).add((r.category, r.name, r.value))
    app = found["ChatOpenAI", "gpt-4o-mini"]
    assert {("OTHER", "v-evidence-source", "file:app.py"), ("OTHER", "v:provenance:provider_endpoint", "https://api.openai.com"), ("OTHER", "v:detector:source_type", "python"), ("SECURITY", "advisory", "v-risk:third-party-provider:ChatOpenAI:app.py")} <= app
    assert not any(name == "advisory" for _, name, _ in found["ConfigModelHint", "gpt-4.1-mini"])
    # what the findings list as dependencies meets the first package of that name, models before frameworks
    depends = {names[r.related][0] for r in relationships.where("relationship = 'DEPENDS_ON'").collect()}
    assert depends == {"anthropic", "langchain", "OpenAI"}
    assert relationships.where("relationship = 'DESCRIBES'").count() == packages.count()


def test_profile_of_the_document(document):
    whole, rows = document
    p = report.ai_profile(rows).first().asDict(recursive=True)
    assert p["repo"] == "p" and p["schema_version"] == "1.0" and p["metadata"]["generated_at"] == "20250101T010203Z"
    assert p["ai_assets"]["models"] == sorted(({"type": m["type"], "model": m["model"], "source_file": m["source_file"], "provider": m["provenance"]["provider_endpoint"]} for m in whole["models"]), key=lambda m: (m["type"], m["model"], m["source_file"]))
    assert p["ai_assets"]["frameworks"] == sorted(f["name"] for f in whole["frameworks"])
    ranks = {"critical": 0, "high": 1, "medium": 2, "low": 3}
    gravest = sorted(whole["risk_findings"], key=lambda r: (ranks[r["severity"]], r["id"]))[:3]
    assert [(r["id"], r["severity"], r["score"], r["title"]) for r in p["risk_highlights"]] == [(r["id"], r["severity"], 0.0, "") for r in gravest]
    summary = p["executive_summary"]
    assert (summary["models"], summary["prompts"], summary["risk_findings"]) == (10, 6, len(whole["risk_findings"]))
    assert summary["high_or_critical_risks"] == sum(r["severity"] in ("high", "critical") for r in whole["risk_findings"])
    assert [d["source_type"] for d in p["detector_coverage"]["detectors"]] == sorted(d["source_type"] for d in whole["coverage_summary"]["detectors"])
    assert p["provenance_and_compliance"]["risk_policy"]["policy"]["policy_id"] == "builtin-default"


def test_profile_of_a_bare_document(spark):
    rows = spark.createDataFrame([("r", "{}"), ("s", '{"models": [{"type": "A"}], "risk_findings": [{"id": "x"}], "tools": null}')], "repo string, text string")
    parsed = rows.select("repo", F.from_json("text", inventory.DOCUMENT).alias("document"))
    bare, some = (r.asDict(recursive=True) for r in report.ai_profile(parsed).orderBy("repo").collect())
    assert bare["ai_assets"] == {"models": [], "tools": [], "datasets": [], "frameworks": []} and bare["risk_highlights"] == []
    assert bare["detector_coverage"] == {"unsupported_total": 0, "detectors": []}
    assert some["ai_assets"]["models"] == [{"type": "A", "model": "unknown", "source_file": "unknown", "provider": "unknown"}]
    assert some["risk_highlights"] == [{"id": "x", "title": "", "severity": "", "score": 0.0, "rule_id": ""}]


def test_long_documents_come_back(spark, tmp_path):
    """Longer than the 20 million characters that the reader takes by itself, in all or in one value."""
    item = F.lit(json.dumps({"type": "t", "model": "m" * 100}))
    many = F.concat(F.lit('{"models":['), F.array_join(F.array_repeat(item, 200_000), ","), F.lit("]}"))
    long = F.concat(F.lit('{"schema_version":"'), F.repeat(F.lit("v"), 21_000_000), F.lit('"}'))
    made = spark.range(2).select(F.when(F.col("id") == 0, "o/many").otherwise("o/long").alias("repo"), F.when(F.col("id") == 0, many).otherwise(long).alias("document"))
    assert made.agg(F.min(F.length("document"))).first()[0] > 20_000_000
    write_documents(made, f"{tmp_path}/docs")
    p = report.ai_profile(read_documents(spark, f"{tmp_path}/docs", inventory.DOCUMENT))
    found = p.select("repo", "executive_summary.models", F.size("ai_assets.models"), F.length("schema_version")).collect()
    assert {tuple(r) for r in found} == {("o/many", 200_000, 200_000, 3), ("o/long", 0, 0, 21_000_000)}


def test_policy_from_a_file(spark, tmp_path):
    path = tmp_path / "policy.json"
    path.write_text(json.dumps({"policy_id": "org", "version": 3, "rule_overrides": {"exfil-surface": {"enabled": False}, "third-party-provider": {"severity": "low", "rule_id": "ORG-9"}}}))
    policy, source = risk.load_policy(spark, str(path))
    assert source["policy_id"] == "org" and source["version"] == "3" and len(source["sha256"]) == 64
    rows = spark.createDataFrame([("r", "tool", "SerpAPI", "a.py"), ("r", "model", "OpenAI", "b.py")], "repo string, entity_type string, name string, source_file string")
    found = risk.evaluate(rows, policy)
    assert [(r.rule_id, r.severity) for r in found.findings.collect()] == [("ORG-9", "low")]
    (tmp_path / "list.json").write_text("[]")
    for bad in ("list.json", "policy.yaml"):
        with pytest.raises(ValueError):
            risk.load_policy(spark, str(tmp_path / bad))


def test_markdown_and_reports_by_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None)], "repo string, models int, error string")
    assert report.markdown_summary(rows).first().line == "| a | 1 | - |"
    (tmp_path / "lines.json").write_text('{"Name": "a", "License": "MIT"}\n{"Name": "b", "License": "Custom"}\n')
    assert {(r.name, r.verdict) for r in license_report(spark, str(tmp_path / "lines.json"), lines=True).collect()} == {("a", "ok"), ("b", "unlisted")}
