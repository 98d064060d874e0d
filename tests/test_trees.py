"""Source trees: listing by level, error rows, balanced reading."""

import os

import pytest
from pyspark.sql import functions as F

from stocktake.operators import drift, inventory, risk
from stocktake.sources import tree

ROOTS = "repo string, root string"


@pytest.fixture
def folder(tmp_path):
    for name in ("a/x.py", "a/deep/er/y.py", "a/.env", "a/venv/z.py", "a/venv/n.ipynb", "a/node_modules/q/m.ipynb", "b/one.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (tmp_path / "a" / "loop").symlink_to(tmp_path / "a")
    (tmp_path / "a" / "dangling").symlink_to(tmp_path / "nowhere")
    (tmp_path / "file").write_text("no folder")
    return tmp_path


def test_every_level_is_listed_and_bad_roots_are_rows(spark, folder):
    roots = [("a", f"{folder}/a"), ("b", f"{folder}/b"), ("gone", f"{folder}/gone"), ("file", f"{folder}/file"), ("null", None)]
    found = tree.list_trees(spark.createDataFrame(roots, ROOTS))
    assert sorted((r.repo, r.rel_path, r.bytes) for r in found.files.collect()) == [("a", ".env", 6), ("a", "deep/er/y.py", 14), ("a", "node_modules/q/m.ipynb", 24), ("a", "venv/n.ipynb", 14), ("a", "x.py", 6), ("b", "one.txt", 9)]
    errors = {(r.repo, r.rel_path): r.error for r in found.errors.collect()}
    assert errors == {("gone", ""): "No such file or directory", ("file", ""): "Not a directory", ("null", ""): "no root"}
    texts = {(r.repo, r.rel_path): r.text for r in tree.files_of(tree.contents(found.files)).collect()}
    assert texts["a", "deep/er/y.py"] == "a/deep/er/y.py" and len(texts) == 6


def test_no_roots(spark):
    found = tree.list_trees(spark.createDataFrame([], ROOTS))
    assert found.files.isEmpty() and found.errors.isEmpty() and tree.contents(found.files).isEmpty()


def test_a_folder_without_permission_is_a_row(monkeypatch, folder):
    real = os.scandir

    def denied(path):
        if str(path).endswith("deep"):
            raise PermissionError(13, "Permission denied")
        return real(path)

    monkeypatch.setattr(os, "scandir", denied)
    assert list(tree.entries("a", f"{folder}/a", "deep")) == [("a", f"{folder}/a", "deep", "error", None, "Permission denied")]
    assert ("x.py", "file") in {(r[2], r[3]) for r in tree.entries("a", f"{folder}/a", "")}


def test_files_without_permission_or_too_large_are_rows(monkeypatch, folder):
    monkeypatch.setattr(os, "access", lambda path, mode: not str(path).endswith(".env"))
    found = {r[2]: r[5] for r in tree.entries("a", f"{folder}/a", "", max_bytes=6) if r[3] == "error"}
    assert found == {".env": "Permission denied"}
    assert {r[2]: r[5] for r in tree.entries("b", f"{folder}/b", "", max_bytes=8)} == {"one.txt": "larger than 8 bytes"}


class Million:
    """A folder of a million files, whose entries are made as they are asked for."""

    class Entry:
        def __init__(self, k):
            self.name, self.path = f"f{k}.py", f"/m/f{k}.py"

        def is_dir(self, follow_symlinks=True):
            return False

        def is_file(self):
            return True

        def stat(self):
            return os.stat_result((0, 0, 0, 0, 0, 0, 7, 0, 0, 0))

    def __enter__(self):
        return (self.Entry(k) for k in range(1_000_000))

    def __exit__(self, *_):
        return None


def test_a_folder_of_a_million_files_is_listed_in_batches(monkeypatch):
    monkeypatch.setattr(os, "scandir", lambda path: Million())
    monkeypatch.setattr(os, "access", lambda path, mode: True)
    sizes = [b.num_rows for b in tree._batches(tree.entries("m", "/m", ""))]
    assert sum(sizes) == 1_000_000 and max(sizes) == tree.ENTRIES


def test_files_of_one_folder_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"f{k}.py").write_text("x" * 1000)
    monkeypatch.setattr(tree, "PART_BYTES", 20_000)
    files = tree.list_trees(spark.createDataFrame([("r", str(tmp_path))], ROOTS)).files
    tasks = tree.contents(files).groupBy(F.spark_partition_id()).agg(F.sum(F.length("content")).alias("n")).collect()
    assert sum(r.n for r in tasks) == 300_000 and len(tasks) == 15 and max(r.n for r in tasks) < 60_000


def test_files_that_went_away_are_unreadable(spark, folder):
    files = tree.list_trees(spark.createDataFrame([("b", f"{folder}/b")], ROOTS)).files
    os.remove(f"{folder}/b/one.txt")
    assert [tuple(r) for r in tree.contents(files).collect()] == [("b", "one.txt", None)]


def test_written_trees_are_read_back(spark, tmp_path):
    rows = [("r1", ".hidden/_a", b"1"), ("r1", "b", None), ("r2", "c/d/e", b"\xff\x00")]
    tree.write_trees(spark.createDataFrame(rows, "repo string, rel_path string, content binary"), str(tmp_path))
    found = tree.list_trees(spark.createDataFrame([("r1", f"{tmp_path}/r1"), ("r2", f"{tmp_path}/r2")], ROOTS))
    assert sorted((r.repo, r.rel_path, bytes(r.content)) for r in tree.contents(found.files).collect()) == [("r1", ".hidden/_a", b"1"), ("r1", "b", b""), ("r2", "c/d/e", b"\xff\x00")]


def test_summary_of_a_scan_with_a_failed_repository(spark, folder):
    (folder / "a" / "m.py").write_text('from openai import OpenAI\nm = OpenAI(model="x")\n')
    repos = spark.createDataFrame([("org/a", f"{folder}/a"), ("org/b", f"{folder}/b"), ("other/gone", f"{folder}/gone")], ROOTS)
    found = tree.list_trees(repos)
    stock = inventory.take_stock(tree.files_of(tree.contents(found.files)))
    counts = inventory.section_counts(stock, risk.evaluate(inventory.entities(stock)).findings)
    errors = found.errors.select("repo", F.col("error").alias("reason"))
    summary = drift.scan_summary(repos, counts, errors, drift.scan_gates(counts, max_high_risk=0)).persist()
    rows = {r.repo: (r.status, r.models, r.high_or_critical_risks, r.gate_verdict, r.gate_failures) for r in summary.collect()}
    assert rows == {"org/a": ("ok", 1, 1, "fail", ["max-high-risk"]), "org/b": ("ok", 0, 0, "pass", []), "other/gone": ("error", 0, 0, "fail", ["scan-error"])}
    totals = {(r.organisation, r.section): (r.level, r.repositories, r.failed, r.total, r.gate_verdict) for r in drift.rollup(summary, F.substring_index("repo", "/", 1)).collect()}
    assert totals[None, None] == ("all", 3, 2, 3, "fail")
    assert totals["org", None] == ("organisation", 2, 1, 3, "fail") and totals["org", "models"] == ("section", 2, 1, 1, "fail")
    assert totals["other", "tools"] == ("section", 1, 1, 0, "fail") and len(totals) == 2 * 7 + 2 + 1
