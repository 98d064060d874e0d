"""Lifetimes of keys, the keyed stream, the run index, and schemas as columns."""

import json
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stocktake.functions.schema import violations
from stocktake.operators import drift
from stocktake.sources import history
from stocktake.streaming.drift import CHANGES, SNAPSHOT, KeyDrift, follow

RUNS = "repo string, section string, key string, payload string, run_id string"
DAY = datetime(2025, 1, 1)


def test_lifetimes_of_keys(spark):
    seen = {"new": "5", "kept": "12345", "back": "1245", "gone": "12", "thrice": "135"}
    rows = [("r", "models", k, "{}", f"run{n}") for k, runs in seen.items() for n in runs for _ in range(2)]
    rows += [("other", "models", "kept", "{}", "run1")]
    found = {(r.repo, r.key): tuple(r)[3:] for r in drift.lifetimes(spark.createDataFrame(rows, RUNS)).collect()}
    assert found == {
        ("r", "new"): ("run5", "run5", 1, 0, 0, "new"),
        ("r", "kept"): ("run1", "run5", 5, 0, 0, "present"),
        ("r", "back"): ("run1", "run5", 4, 1, 1, "present"),
        ("r", "gone"): ("run1", "run2", 2, 0, 0, "gone"),
        ("r", "thrice"): ("run1", "run5", 3, 2, 1, "returned"),
        ("other", "kept"): ("run1", "run1", 1, 0, 0, "new"),
    }
    assert drift.lifetimes(spark.createDataFrame([], RUNS)).isEmpty()


def plain_changes(rows, keep):
    """The changes of each key, sighting after sighting."""
    newest = max(r[4] for r in rows)
    keys = {}
    for repo, section, key, payload, at in rows:
        own = keys.setdefault((repo, section, key), {})
        own[at] = max(own.get(at, ""), payload)
    out = []
    for key, own in keys.items():
        last = None
        for at in sorted(own):
            if last is not None and last + keep < at:
                out.append((*key, last + keep, "removed", own[last]))
                last = None
            if last is None:
                out.append((*key, at, "added", own[at]))
            elif own[last] != own[at]:
                out.append((*key, at, "changed", own[at]))
            last = at
        if last + keep < newest:
            out.append((*key, last + keep, "removed", own[last]))
    return sorted(out)


def collected(df):
    return sorted((r.repo, r.section, r.key, r.at, r.status, r.payload) for r in df.collect())


def test_changes_of_keys_as_table_and_stream(spark, tmp_path):
    """Late, repeated and replayed snapshots; two times of one key in one batch."""
    r = random.Random(3)
    keep = timedelta(days=4)
    sightings = [("r" + str(r.randint(0, 1)), "models", f"k{r.randint(0, 5)}", r.choice("ab"), DAY + timedelta(days=r.randint(0, 40))) for _ in range(120)]
    want = plain_changes(sightings, keep)
    table = spark.createDataFrame(sightings, SNAPSHOT)
    assert collected(drift.key_changes(table, "4 DAY")) == want
    # arrival in the order of time, but up to nine days late; a part comes twice, a part again much later
    order = sorted(sightings, key=lambda s: s[4] + timedelta(days=r.randint(0, 9)))
    batches = [order[:50], order[30:80], order[80:], order[:20]]
    end = ("end", "models", "end", "x", DAY + timedelta(days=60))
    for part in (*batches, [end]):
        spark.createDataFrame(part, SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        follow(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", keep, late="10 days").awaitTermination()
    got = [c for c in collected(spark.read.schema(CHANGES).parquet(f"{tmp_path}/out")) if c[0] != "end"]
    assert got == [c for c in plain_changes([*sightings, end], keep) if c[0] != "end"]


class CountedState:
    """A key's state and timers in memory; counts how often they are asked."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def __getattr__(self, name):
        def ask(*values):
            self.asked += 1
            if name == "get":
                return self.value
            if name in ("update", "clear"):
                self.value = values[0] if values else None
            else:
                {"registerTimer": self.timers.add, "deleteTimer": self.timers.remove}[name](*values)

        return ask


def test_a_key_asks_for_its_state_a_few_times_a_batch(spark):
    """Not for each of its sightings; one past its end it is removed, at its end it is still kept."""
    times = [3, 1, 2, 5, 9, *range(20, 320), 323]
    batches = [times[:5], times[5:], [329], []]
    state, out = CountedState(), []
    keys = KeyDrift(timedelta(milliseconds=4))
    keys.init(state)
    for rows in batches:
        state.asked = 0
        watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: max(rows, default=334))  # noqa: B023
        if rows:
            found = keys.handleInputRows(("r", "models", "k"), iter([Row(ms=at, payload="ab"[at > 100]) for at in rows]), watermark)
        else:
            [end] = state.timers
            assert end == 334
            found = keys.handleExpiredTimer(("r", "models", "k"), watermark, SimpleNamespace(getExpiryTimeInMs=lambda: end))  # noqa: B023
        out += [tuple(c) for r in found for c in r["found"]]
        assert state.asked <= 4 and len(state.timers) <= 1
    assert out == [(1, "added", "a"), (13, "removed", "a"), (20, "added", "a"), (101, "changed", "b"), (327, "removed", "b"), (329, "added", "b"), (333, "removed", "b")]


def test_stream_of_a_key_with_many_sightings(spark, tmp_path):
    """A thousand times of one key, some twice in other files and some without payload."""
    keep = timedelta(minutes=2)
    sightings = [("r", "models", "busy", None if n % 7 == 0 else "ab"[n % 3 == 0], DAY + timedelta(minutes=n + 10 * (n // 100))) for n in range(1000)]
    sightings += [("r", "models", "k", "x", DAY + timedelta(minutes=m)) for m in (5, 7, 10)]
    want = collected(drift.key_changes(spark.createDataFrame(sightings, SNAPSHOT), "2 MINUTES"))
    for part in (sightings, sightings[::3]):
        spark.createDataFrame(part, SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    follow(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", keep).awaitTermination()
    rows = spark.read.schema(CHANGES).parquet(f"{tmp_path}/out")
    assert collected(rows.fillna("-")) == sorted((*c[:5], c[5] or "-") for c in want)


def test_changes_equal_the_trend_of_daily_runs(spark):
    """Keys that the table of changes adds are those that the trend calls new."""
    r = random.Random(4)
    runs = [("r", "models", f"k{k}", "{}", f"2025-01-{d:02d}") for d in range(1, 15) for k in range(9) if r.random() < 0.3]
    every = spark.createDataFrame(runs, RUNS)
    changes = collected(drift.key_changes(every.withColumn("at", F.to_timestamp("run_id")), "3 DAY"))
    for d in range(2, 15):
        now = f"2025-01-{d:02d}"
        if {x[4] for x in runs} >= {f"2025-01-{i:02d}" for i in range(max(1, d - 3), d)}:
            new = drift.trend(every.where(F.col("run_id") == now), every.where(F.col("run_id") < now), 3)[1]
            assert {x.key for x in new.collect()} == {c[2] for c in changes if c[4] == "added" and c[3] == datetime(2025, 1, d)}


SNAP = "repo string, key string"


def test_index_names_the_folders_that_are_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    for n in range(12):
        repos = ["daily"] + (["weekly"] if n % 6 == 0 else [])
        history.append_run(spark.createDataFrame([(r, f"k{n}") for r in repos], SNAP), path, f"run{n:02d}", cap=4)
    # the last four of daily, and the two of weekly
    assert sorted(p.name for p in (tmp_path / "runs" / "data").iterdir() if p.is_dir()) == [f"run_id=run{n:02d}" for n in (0, 6, 8, 9, 10, 11)]
    found = history.read_runs(spark, path, 2)
    assert sorted((r.repo, r.run_id, r.key) for r in found.collect()) == [("daily", "run10", "k10"), ("daily", "run11", "k11"), ("weekly", "run00", "k0"), ("weekly", "run06", "k6")]
    read = {p.split("run_id=")[1].split("/")[0] for p in found.inputFiles() if "/data/" in p}
    assert read == {"run00", "run06", "run10", "run11"}
    assert {(r.repo, r.run_id) for r in history.latest(spark, path).collect()} == {("daily", "run11"), ("weekly", "run06")}


def test_a_run_without_index_never_happened(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert history.read_index(spark, path).isEmpty() and history.read_runs(spark, path).isEmpty()
    history.append_run(spark.createDataFrame([("r", "a")], SNAP), path, "1")
    spark.createDataFrame([("r", "half")], SNAP).write.parquet(f"{path}/data/run_id=2")
    assert [r.key for r in history.read_runs(spark, path).collect()] == ["a"]
    history.append_run(spark.createDataFrame([("r", "b")], SNAP), path, "2")
    history.append_run(spark.createDataFrame([("r", "c")], SNAP), path, "2")
    assert sorted(r.key for r in history.read_runs(spark, path).collect()) == ["a", "c"]


def faults(spark, schema, *documents):
    texts = [d if isinstance(d, str) or d is None else json.dumps(d) for d in documents]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", violations(F.col("text"), schema).alias("v"))
    return [[tuple(f) for f in r.v] for r in rows.orderBy("n").collect()]


_UNKNOWN = {"type": "string"}
DOCUMENT = {
    "type": "object",
    "required": ["metadata", "models", "schema_version", "tools"],
    "properties": {
        "schema_version": {"type": "string"},
        "metadata": {"type": "object", "required": ["generated_at", "git_sha", "artifact_sha256"], "properties": {"artifact_sha256": {"type": "string", "pattern": "^[a-f0-9]{64}$"}}},
        "models": {"type": "array", "items": {"type": "object", "required": ["type", "model", "source_file"], "properties": {"provenance": {"$ref": "#/$defs/provenance"}}, "additionalProperties": True}},
        "tools": {"type": "array", "items": {"type": "object", "required": ["name"]}},
    },
    "$defs": {
        "provenance": {"type": "object", "additionalProperties": False, "properties": {"region": _UNKNOWN, "lineage": {"$ref": "#/$defs/lineage"}}},
        "lineage": {"type": "object", "additionalProperties": False, "properties": {"image_digest": {"type": "string", "pattern": "^(unknown|sha256:.+)$"}}},
    },
}


def test_documents_with_and_without_faults(spark):
    good = {"schema_version": "1.0", "metadata": {"generated_at": "t", "git_sha": "g", "artifact_sha256": "0" * 64}, "models": [{"type": "a", "model": "b", "source_file": "c", "more": 1, "provenance": {"region": "eu", "lineage": {"image_digest": "sha256:1"}}}], "tools": []}
    missing = {"schema_version": "1.0", "metadata": {"git_sha": "g", "artifact_sha256": "xyz"}, "models": [{"type": "a", "model": "b"}], "tools": [{}]}
    closed = {**good, "models": [{"type": "a", "model": "b", "source_file": "c", "provenance": {"region": 1, "color": "red", "lineage": {"image_digest": "x", "y/z~": 1}}}]}
    assert faults(spark, DOCUMENT, good, missing, closed, "[]", "{", None, "null") == [
        [],
        [("/metadata/artifact_sha256", "value does not match ^[a-f0-9]{64}$"), ("/metadata/generated_at", "'generated_at' is a required property"), ("/models/0/source_file", "'source_file' is a required property"), ("/tools/0/name", "'name' is a required property")],
        [("/models/0/provenance/color", "property is not allowed"), ("/models/0/provenance/lineage/image_digest", "value does not match ^(unknown|sha256:.+)$"), ("/models/0/provenance/lineage/y~1z~0", "property is not allowed"), ("/models/0/provenance/region", "value is not of type string")],
        [("/", "value is not of type object")],
        [("/", "document is not JSON")],
        [("/", "document is not JSON")],
        [("/", "value is not of type object")],
    ]


CASES = [
    ({"type": "integer"}, [1, 1.0, 10**30, "1", 1.5, True, None], [0, 0, 0, 1, 1, 1, 1]),
    ({"type": ["number", "null"]}, [1.5, None, "x"], [0, 0, 1]),
    ({"minimum": 2, "exclusiveMaximum": 5}, [2, 5, 1.9, 4.9, "1"], [0, 1, 1, 0, 0]),
    ({"enum": [1, "a", None, {"k": [1]}]}, [1.0, "a", None, {"k": [1]}, {"k": [2]}, "1"], [0, 0, 0, 0, 1, 1]),
    ({"const": "ü"}, ["ü", "u"], [0, 1]),
    ({"minLength": 2, "maxLength": 3}, ["a", "ab", "😀😀😀", "abcd", 1], [1, 0, 0, 1, 0]),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[], [1], [1, 1], [1, 2, 3], {}], [1, 0, 1, 1, 0]),
    ({"patternProperties": {"^n": {"type": "number"}}, "additionalProperties": {"type": "string"}}, [{"n": 1, "s": "x"}, {"n": "x", "s": 1}, {}], [0, 2, 0]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["x", 3, 2], [0, 0, 1]),
    ({"oneOf": [{"type": "number"}, {"minimum": 3}]}, [1, 4, "x"], [0, 1, 0]),
    ({"not": {"type": "object"}, "allOf": [{"type": ["array", "object"]}]}, [[], {}, 1], [0, 1, 1]),
    ({"items": {"items": {"type": "integer"}}}, [[[1], [2, "x"], 3], [["a", "b"]]], [1, 2]),
    (False, [1], [1]),
    ({"properties": {"a": False}}, [{}, {"a": 1}], [0, 1]),
]


@pytest.mark.parametrize(("schema", "values", "counts"), CASES)
def test_keywords(spark, schema, values, counts):
    assert [len(f) for f in faults(spark, schema, *map(json.dumps, values))] == counts


def test_schemas_without_an_expression(spark):
    for schema in ({"$ref": "#"}, {"$ref": "other.json"}, {"if": True}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}):
        with pytest.raises(ValueError):
            violations(F.col("x"), schema)
