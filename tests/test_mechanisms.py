"""Predicate rules, canonical text, sketches, and the nested writer."""

import json
import os
import random
import resource

import pytest
from pyspark.sql import functions as F

from stocktake import constants as C
from stocktake.functions import columns as X
from stocktake.operators import drift, risk
from stocktake.sources import history, nested


def test_rules_are_predicates_in_one_pass(spark):
    rows = [("r", "model", "A", "a.py", "eu"), ("r", "model", "B", None, "us"), ("r", "tool", "SerpAPI", "t.py", None), ("s", "model", "OpenAI", "b.py", "us")]
    entities = spark.createDataFrame(rows, "repo string, entity_type string, name string, source_file string, region string")
    own = [{**C.RULES[0], "base_rule_id": "abroad", "when": "region <> 'eu'"}, {**C.RULES[0], "base_rule_id": "python", "when": F.col("source_file").endswith(".py")}]
    policy = {"rule_overrides": {"abroad": {"severity": "low", "allowlist": [{"name": "OpenAI", "reason": "known"}]}, "python": {"threshold": 3}}}
    found = risk.evaluate(entities, policy, own)
    assert {(r.base_rule_id, r.repo, r.name) for r in found.findings.collect()} == {("abroad", "r", "B"), ("exfil-surface", "r", "SerpAPI"), ("third-party-provider", "s", "OpenAI")}
    assert {(r.repo, r.base_rule_id, r.reason) for r in found.suppressed.where("base_rule_id IN ('abroad', 'python')").collect()} >= {("s", "abroad", "known"), ("r", "python", "threshold-not-met: 2 < 3"), ("s", "python", "threshold-not-met: 1 < 3")}
    assert {(r.repo, r.candidate_count) for r in found.applied.where("base_rule_id = 'python'").collect()} == {("r", 2), ("s", 1)}
    plan = found.findings._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [entity_type" not in plan and "[name#" not in "".join(line for line in plan.split("\n") if "BroadcastHashJoin" in line)


def random_text(r):
    pool = "ab\"\\/<>&\b\f\n\r\t\x00\x0b\x0e\x1f\x7f\x80éßΩ ퟿￿😀𐍈\U0010ffff"
    return "".join(r.choice(pool) for _ in range(r.randint(0, 30)))


def test_canonical_text_equals_sorted_json(spark):
    r = random.Random(6)
    schema = "z string, a struct<y:int,b:array<struct<q:string,c:boolean>>,n:string>, M map<string,string>"
    rows, want = [], []
    for _ in range(200):
        value = {"z": r.choice([None, random_text(r)]), "a": {"y": r.randint(-5, 5), "b": [{"q": random_text(r), "c": r.choice([True, False, None])} for _ in range(r.randint(0, 3))], "n": None}, "M": {random_text(r): random_text(r) for _ in range(r.randint(0, 3))}}
        rows.append((value["z"], (value["a"]["y"], [(b["q"], b["c"]) for b in value["a"]["b"]], None), value["M"]))
        want.append(json.dumps(value, sort_keys=True, separators=(",", ":")))
    df = spark.createDataFrame(rows, schema).select(F.struct("*").alias("v"))
    assert [x.t for x in df.select(X.canonical(F.col("v"), df.schema["v"].dataType).alias("t")).collect()] == want


def test_ascii_json_keeps_escaped_backslashes(spark):
    texts = ["\\u001F", "a\x1f", "\\\x0b", "\\\\u000B"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.ascii_json(F.to_json(F.struct("t"))).alias("j"))
    assert [r.j for r in rows.collect()] == [json.dumps({"t": t}, separators=(",", ":")) for t in texts]


def test_sketches_give_the_rows_of_the_exact_join(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    path = str(tmp_path / "runs")
    # few bits, so that chance hits come and are verified
    monkeypatch.setattr(history, "BUCKETS", 1)
    monkeypatch.setattr(history, "BITS", 64)
    runs = [("r" + str(k % 2), "models", f"k{r.randint(0, 60)}", "{}", f"run{n}") for n in range(6) for k in range(20)]
    every = spark.createDataFrame(runs, "repo string, section string, key string, payload string, run_id string").dropDuplicates(["run_id", *drift.KEY])
    history.append_runs(every, path, sketch=drift.KEY)
    current = spark.createDataFrame([(f"r{k % 2}", "models", f"k{k}", "{}") for k in range(80)], "repo string, section string, key string, payload string")
    for window in (1, 3, 6):
        kept = {f"run{n}" for n in range(6 - window, 6)}
        held = {(x.repo, x.section, x.key) for x in every.collect() if x.run_id in kept}
        found = {(x.repo, x.section, x.key) for x in history.novel_keys(spark, path, current, drift.KEY, window).collect()}
        assert found == {(x.repo, x.section, x.key) for x in current.collect()} - held
        hits = history.may_hold(spark, path, current, drift.KEY, window).count()
        assert hits > len(held & {(x.repo, x.section, x.key) for x in current.collect()})  # by chance, too


def test_only_runs_that_may_hold_a_key_are_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    for n in range(5):
        rows = [("r", "models", f"key-{n}-{k}", "{}") for k in range(50)]
        history.append_run(spark.createDataFrame(rows, "repo string, section string, key string, payload string"), path, f"run{n}", sketch=drift.KEY)
    ask = lambda *keys: spark.createDataFrame([("r", "models", k, "{}") for k in keys], "repo string, section string, key string, payload string")
    assert {x.run_id for x in history.may_hold(spark, path, ask("key-3-7", "other"), drift.KEY, 5).collect()} == {"run3"}
    found = history.novel_keys(spark, path, ask("key-3-7", "other"), drift.KEY, 5)
    assert {p.split("run_id=")[1].split("/")[0] for p in found.inputFiles() if "/data/" in p} == {"run3"}
    assert [x.key for x in found.collect()] == ["other"]
    nothing = history.novel_keys(spark, path, ask("other"), drift.KEY, 5)
    assert not [p for p in nothing.inputFiles() if "/data/" in p]


def test_documents_are_written_in_order(spark, tmp_path):
    rows = [("a/b", "tools", "2", '{"n":2}'), ("a/b", "tools", "1", '{"n":1}'), ("a/b", "models", "x", '{"m":"ü"}'), ("c", "last", "1", "1"), (None, "tools", "1", "1")]
    path = str(tmp_path / "out")
    nested.write_nested(spark.createDataFrame(rows, nested.ROWS), path, ["models", "tools", "last"], spark.createDataFrame([("empty",), ("c",)], "repo string"))
    found = {name: json.load(open(f"{path}/{name}", encoding="utf-8")) for name in os.listdir(path)}
    assert found == {"a%2fb.json": {"models": [{"m": "ü"}], "tools": [{"n": 1}, {"n": 2}], "last": []}, "c.json": {"models": [], "tools": [], "last": [1]}, "empty.json": {"models": [], "tools": [], "last": []}}
    assert [list(v) for v in found.values()] == [["models", "tools", "last"]] * 3
    nested.write_nested(spark.createDataFrame([], nested.ROWS), path, ["models"])
    assert len(os.listdir(path)) == 3


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(200).selectExpr("concat('r', id % 20) AS repo", "'tools' AS section", "string(id) AS key", "IF(id = 150, raise_error('broken'), '{}') AS item")
    with pytest.raises(Exception, match="broken|job"):
        nested.write_nested(rows, path, ["tools"])
    assert not os.path.exists(path) or os.listdir(path) == []
    with pytest.raises(Exception, match="no such section|job"):
        nested.write_nested(spark.createDataFrame([("r", "other", "1", "1")], nested.ROWS), path, ["tools"])
    assert not os.path.exists(path) or os.listdir(path) == []


def test_a_killed_task_leaves_nothing_in_the_target(tmp_path):
    """A task that ends in the middle has written beside the target only."""
    from types import SimpleNamespace

    writer = nested._Writer(str(tmp_path), ["s"], "job")
    task = SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 7)

    def rows():
        yield {"repo": "r", "section": "s", "key": "1", "item": "1"}
        raise MemoryError

    with pytest.MonkeyPatch.context() as m:
        m.setattr(nested.TaskContext, "get", lambda: task)
        with pytest.raises(MemoryError):
            writer.write(rows())
        assert os.listdir(tmp_path) == ["_writing-job"]
        done = writer.write(iter([{"repo": "r", "section": "s", "key": "1", "item": "1"}]))
        writer.commit([done, None])
    assert os.listdir(tmp_path) == ["r.json"] and json.load(open(tmp_path / "r.json")) == {"s": [1]}


def test_a_large_document_takes_the_memory_of_a_row(tmp_path):
    from types import SimpleNamespace

    writer = nested._Writer(str(tmp_path), ["s"], "job")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(nested.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 1))
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        row = {"repo": "r", "section": "s", "key": "1", "item": json.dumps({"text": "x" * 80})}
        writer.commit([writer.write(row for _ in range(1_000_000))])
    assert os.path.getsize(tmp_path / "r.json") > 90_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000
