"""Detectors, inventory, risk, drift and exports over a small source tree."""

import hashlib
import json
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from stocktake import constants as C
from stocktake.functions import parsers
from stocktake.operators import detect, drift, export, inventory, report, risk
from stocktake.operators.relational import match_exceptions
from stocktake.sources.history import append_run, last_runs, read_documents, read_runs, write_documents
from stocktake.sources.tree import license_report, read_trees, repo_list

FILES = {
    ".env": "OPENAI_API_KEY=sk-test-value\nANTHROPIC_API_KEY=anth-test\n# X=1\n",
    "app.py": 'from langchain.vectorstores import FAISS\nllm = ChatOpenAI(model="gpt-4o-mini")\nstore = FAISS.from_texts([])\nllm()\ninitialize_agent(llm)\nPromptTemplate("hello {x}")\n',
    "bad.py": "def (",
    "venv/skipped.py": "OpenAI()",
    "venv/kept.ipynb": json.dumps({"cells": [{"cell_type": "code", "source": "FAISS.x()"}]}),
    "nb.ipynb": json.dumps({"cells": [{"cell_type": "markdown", "source": "x"}, {"cell_type": "code", "source": ["from openai import OpenAI\n", "c = OpenAI(model='m1')"]}]}),
    "settings.yaml": "model: gpt-4.1-mini\nprovider: openai\nregion: eu-1\n",
    "package.json": json.dumps({"dependencies": {"langchain": "1"}, "devDependencies": {"zod": "2"}}),
    "Dockerfile": "FROM reg.io/python:3.11-slim\n",
    "a.ts": 'import { ChatOpenAI } from "@langchain/openai";\nconst m = new ChatOpenAI({ model: "gpt-4" });\nconst t = tool(x);\n',
    "A.java": 'import com.openai.Client;\nvar m = new OpenAiChatModel("gpt-x");\nRequests(Agent)\n',
    "pyproject.toml": "[x]\n",
}


@pytest.fixture(scope="module")
def tree(spark):
    root = tempfile.mkdtemp()
    for name, text in FILES.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    with open(f"{root}/latin.py", "wb") as f:
        f.write(b"x = '\xff'")
    return read_trees(spark, {"r1": root})


@pytest.fixture(scope="module")
def facts(tree):
    return detect.all_facts(tree).persist()


@pytest.fixture(scope="module")
def stock(tree, facts):
    return inventory.take_stock(tree, facts=facts)


def test_models_and_context(stock):
    found = {(r.type, r.model, r.source_file, r.provider_endpoint, r.region) for r in stock.models.collect()}
    api = "https://api.openai.com"
    assert found == {
        ("ChatOpenAI", "gpt-4o-mini", "app.py", api, "eu-1"),
        ("ChatOpenAI", "unknown", "app.py", api, "eu-1"),
        ("OpenAI", "m1", "nb.ipynb#cell-1", api, "eu-1"),
        ("ConfigModelHint", "gpt-4.1-mini", "settings.yaml", "unknown", "eu-1"),
        ("ChatOpenAI", "gpt-4", "a.ts:2", api, "eu-1"),
        ("OpenAI", "gpt-x", "A.java:2", api, "eu-1"),
    }
    assert stock.context.first().registry_uri == "reg.io/python"


def test_evidence_is_masked(stock):
    evidence = {r.evidence for r in stock.scan_findings.where("category = 'provider credential'").collect()}
    assert evidence == {"OPENAI_API_KEY=[masked:sk*********ue hash:928d882b4239]", "ANTHROPIC_API_KEY=[masked:an*****st hash:25e2f144a82b]"}


def test_coverage_counts_unreadable_files(stock):
    seen = {r.source_type: (r.artifacts_seen, r.artifacts_scanned) for r in stock.coverage.collect()}
    assert seen["python"] == (3, 1) and seen["go_ast"] == (0, 0) and len(seen) == 9
    assert [r.path for r in stock.unsupported.collect()] == ["pyproject.toml"]


def test_risks_document_and_exports(stock):
    entities = inventory.entities(stock)
    found = risk.evaluate(entities, {"rule_overrides": {"exfil-surface": {"enabled": False}}})
    assert {(r.id, r.severity) for r in found.findings.where("rule_id = 'prompt-injection-surface'").collect()} == {("prompt-injection-surface:prompt_templates:", "medium")}
    assert [r.reason for r in found.suppressed.collect()] == ["disabled-by-policy"]
    made = inventory.documents(stock, generated_at="20250101T010203Z").first()
    document = json.loads(made.document)
    assert len(document["models"]) == 6 and document["runtime_context"]["region"] == "eu-1"
    assert json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == made.document
    without = {**document, "metadata": {k: v for k, v in document["metadata"].items() if k != "artifact_sha256"}}
    text = json.dumps(without, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert document["metadata"]["artifact_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert set(document) == set(stock.models.sparkSession.createDataFrame([], inventory.DOCUMENT).columns)
    for section in ("models", "datasets", "tools", "scan_findings", "prompts"):
        assert document[section] == sorted(document[section], key=lambda x: json.dumps(x, indent=2, sort_keys=True))
    assert document["coverage_summary"]["unsupported_total"] == 1 and len(document["coverage_summary"]["detectors"]) == 9
    assert document["risk_policy"]["policy"]["policy_id"] == "builtin-default"
    folder = tempfile.mkdtemp()
    write_documents(inventory.documents(stock), f"{folder}/docs")
    back = read_documents(stock.models.sparkSession, f"{folder}/docs", inventory.DOCUMENT).first().document.asDict(recursive=True)
    assert [m["model"] for m in back["models"]] == [m["model"] for m in document["models"]] and back["schema_version"] == "1.0"
    related = export.spdx(stock, found.findings)[2].where("relationship = 'DEPENDS_ON'").count()
    assert related == 1
    packages = [r.spdx_id for r in export.in_order(export.spdx(stock, found.findings)[0], "spdx_id").collect()]
    assert packages == sorted(packages) and len(packages) > 1
    components, depends, _ = export.cyclonedx(stock, found.findings)
    listed = export.root_dependencies(depends.unionByName(depends)).first().depends_on
    assert listed == sorted(set(listed)) and set(listed) <= {r.bom_ref for r in components.collect()}
    top = report.top_risks(found.findings).collect()
    assert len(top) == 3 and top[0].severity == "critical"


def test_python_names_follow_bindings():
    events = parsers.python_events("import a.b.C\nfrom . import x\nfrom openai import OpenAI as O\nf = g = O\nm = f(model='x')\nm()\n")
    assert [(e["kind"], e["name"], e["value"]) for e in events if e["kind"] == "model"] == [("model", "OpenAI", "x"), ("model", "OpenAI", "unknown")]
    assert parsers.python_events("def (") is None


def test_nested_settings_in_order():
    assert parsers.setting_leaves('{"a": {"b": 1, "c": [2]}, "d": null}') == [{"key": "b", "value": "1"}, {"key": "c", "value": "[2]"}, {"key": "d", "value": "None"}]
    assert parsers.setting_leaves("{") == []


def test_history_and_drift(spark, stock):
    path = f"{tempfile.mkdtemp()}/runs"
    now = drift.snapshot(stock).persist()
    append_run(now.where("key <> 'OpenAI'"), path, "20250101T000000Z")
    append_run(now.where("section = 'tools'"), path, "20250102T000000Z")
    runs = read_runs(spark, path)
    assert last_runs(runs, 1).select("run_id").distinct().count() == 1
    changes, new, counts = drift.trend(now, runs, 2)
    assert {r.key for r in new.collect()} == {"OpenAI"}
    assert sum(r.added for r in counts.collect()) == changes.count()
    assert {r.gate for r in drift.gates(changes, ["OpenAI"], ["new-model", "new-external-provider"]).collect()} == {"new-model", "new-external-provider"}


def test_repo_list_keeps_first_mentions(spark):
    path = f"{tempfile.mkdtemp()}/repos.txt"
    with open(path, "w") as f:
        f.write("b\n# no\n\na\nb\n")
    assert [r.repo for r in repo_list(spark, path, ["a"]).orderBy("place").collect()] == ["a", "b"]


def test_notebooks_below_ignored_folders_are_read(stock):
    assert [(r.type, r.source_file) for r in stock.datasets.where("source_file LIKE '%ipynb%'").collect()] == [("FAISS.x", "venv/kept.ipynb#cell-0")]


def test_extra_detectors_and_rules(tree):
    def notes(files):
        rows = detect.scan(files, only=["unsupported"]).where("kind = 'unsupported'")
        return rows.withColumns({"kind": F.lit("tool"), "name": F.lit("note"), "source_file": F.col("rel_path")})

    facts = detect.all_facts(tree, extra={"notes": notes})
    stock = inventory.take_stock(tree, facts=facts)
    rule = {**C.RULES[0], "base_rule_id": "own", "names": ["note"]}
    found = risk.evaluate(inventory.entities(stock), more=[rule]).findings.where("base_rule_id = 'own'").collect()
    assert [r.id for r in found] == ["own:note:pyproject.toml"]


def test_scripts_by_words():
    text = """import D, { ChatOpenAI as C } from "@langchain/openai";
const A = require("openai");
const { PromptTemplate: PT } = require("langchain");
const M = C;
let k = new M({ modelName: "z" });
const t = wrap(tool(x), PT("hello world"));
import * as all from "openai";
const b = new A.OpenAI({ model: 'm' });
"""
    events = parsers.script_events(text)
    assert [e["name"] for e in events if e["kind"] == "import"] == ["@langchain/openai", "openai", "langchain"]
    models = [(e["name"], e["value"], e["line"], e["imported"], e["configured"]) for e in events if e["kind"] == "model"]
    # a name bound to require hides the module; the inner call of wrap is no call
    assert models == [("ChatOpenAI", "unknown\n@langchain/openai.ChatOpenAI", 5, True, True), ("OpenAI", "m\nrequire.OpenAI", 8, False, True)]
    assert [(e["kind"], e["name"], e["line"]) for e in events if e["kind"] in ("tool", "prompt")] == [("prompt", "langchain.PromptTemplate", 6)]
    assert parsers.script_events("new (") == [] and parsers.script_events('import { a } from') == []


@pytest.mark.parametrize("piece", ["a(", "new A(", "import {", "const {", "a(b) c("])
def test_unclosed_marks_take_linear_time(piece):
    import time

    times = []
    for size in (50_000, 400_000):
        began = time.process_time()
        parsers.script_events(piece * (size // len(piece)))
        times.append(time.process_time() - began)
    assert times[1] < 20 * max(times[0], 0.02)


def test_exceptions_belong_to_their_values(spark):
    rows = spark.range(2000).selectExpr("id", "IF(id % 3 = 0, 'tool', 'model') AS entity_type", "concat('n', id % 50) AS name").repartition(7)
    known = spark.createDataFrame([(0, "tool", "n6", "one"), (1, "", "n7", "two"), (2, "tool", "", "three")], "pos int, entity_type string, name string, reason string")
    for r in match_exceptions(rows, known, ["entity_type", "name"]).collect():
        tool = r.entity_type == "tool"
        assert r.reason == ("one" if tool and r.name == "n6" else "two" if r.name == "n7" else "three" if tool else None)


def test_license_report_and_first_repositories(spark):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/report.json", "w") as f:
        json.dump([{"Name": "a", "License": "MIT"}, {"Name": "b", "License": "GPL v3"}, {"Name": "c", "License": None}], f)
    assert {(r.name, r.verdict) for r in license_report(spark, f"{folder}/report.json").collect()} == {("a", "ok"), ("b", "copyleft"), ("c", "unknown")}
    with open(f"{folder}/repos", "w") as f:
        f.write("x\ny\nz\n")
    assert {r.repo for r in repo_list(spark, f"{folder}/repos", ["a"], limit=2).collect()} == {"a", "x"}


def test_history_is_capped(spark):
    path = f"{tempfile.mkdtemp()}/runs"
    for k in range(4):
        append_run(spark.createDataFrame([("r", "tools", "t", "{}")], "repo string, section string, key string, payload string"), path, f"2025010{k}T000000Z")
    assert {r.run_id for r in read_runs(spark, path, cap=2).collect()} == {"20250102T000000Z", "20250103T000000Z"}


def test_policy_weights_explain_only(spark):
    rows = spark.createDataFrame([("r", "tool", "SerpAPI", "a.py")], "repo string, entity_type string, name string, source_file string")
    plain, weighed = (risk.evaluate(rows, p) for p in (None, {"scoring": {"weights": {"confidence": 1, "exposure": 0, "provenance": 0}}}))
    assert plain.findings.collect() == weighed.findings.collect()
    assert weighed.weights == {"confidence": 1.0, "exposure": 0.0, "provenance": 0.0}


def test_serials_follow_the_seed(spark):
    rows = [("a", "h1", "g", "t"), ("b", None, "g", "t"), ("c", "DYNAMIC", "g", "t"), ("d", "", "", "t"), ("e", None, None, "ü")]
    found = {r.repo: r for r in export.serials(spark.createDataFrame(rows, "repo string, artifact_sha256 string, git_sha string, document string"), "v").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {k: r.seed for k, r in found.items()} == {"a": "h1", "b": "g", "c": digest("t"), "d": digest("t"), "e": digest("ü")}
    for r in found.values():
        assert r.bom_serial == f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'v:{r.seed}')}"
        assert r.vex_id == f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'v:vex:{r.seed}')}"
