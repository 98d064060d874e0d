"""Drift of inventories: differences of two runs, novelty against a history, and
gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.functions import columns as X
from stocktake.operators.inventory import Inventory
from stocktake.operators.relational import change_counts, difference, keep_last, novel

KEY = ["repo", "section", "key"]


def snapshot(stock: Inventory) -> DataFrame:
    """(repo, section, key, payload) of models and datasets by type and tools by
    name; of rows with one key the last counts."""
    parts = []
    for section, table, key in (("models", stock.models, "type"), ("tools", stock.tools, "name"), ("datasets", stock.datasets, "type")):
        fields = sorted(c for c in table.columns if c != "repo")
        parts.append(table.select("repo", F.lit(section).alias("section"), F.col(key).alias("key"), F.to_json(F.struct(*fields)).alias("payload")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return keep_last(rows, KEY, ["payload"])


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed keys of two snapshots."""
    return difference(old, new, KEY, ["payload"])


def trend(current: DataFrame, runs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes against the last of ``runs`` (run_id and a snapshot's columns),
    keys that none of the last ``window`` runs held, and counts of changes."""
    last = runs.select("repo", "run_id").distinct()
    ranked = last.withColumn("age", F.row_number().over(_newest_first()))
    recent = runs.join(ranked.where(F.col("age") <= window), ["repo", "run_id"])
    changes = compare(recent.where("age = 1").select(*KEY, "payload"), current)
    return changes, novel(current, recent, KEY), change_counts(changes, ["repo", "section"])


def _newest_first():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("repo").orderBy(F.desc("run_id"))


def lifetimes(runs: DataFrame) -> DataFrame:
    """One row for each key of ``runs`` (run_id and ``KEY``): ``first_seen``,
    ``last_seen``, ``runs_seen``, ``absences`` (spans without it between two that
    hold it), ``longest_absence`` in runs, and ``status`` at the repository's last
    run: ``new``, ``present``, ``returned`` or ``gone``.

    Runs are numbered by repository; numbers of a key that follow each other form
    an island, found by their distance to the rank of the row.  All runs are read
    once.  A key has at most one row for each run after the first aggregation, so
    no group grows with repeated rows; a snapshot that comes twice counts once,
    and the order of arrival plays no part.  An empty table gives no row."""
    from pyspark.sql import Window

    numbers = runs.select("repo", "run_id").distinct()
    of_repo = Window.partitionBy("repo")
    numbers = numbers.withColumn("no", F.row_number().over(of_repo.orderBy("run_id"))).withColumn("last_no", F.max("no").over(of_repo))
    seen = runs.select(*KEY, "run_id").distinct().join(numbers, ["repo", "run_id"])
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("no"))
    gap = F.col("no") - F.lag("no").over(Window.partitionBy(*KEY).orderBy("no")) - 1
    spans = seen.withColumn("island", F.col("no") - rank).withColumn("gap", F.coalesce(gap, F.lit(0)))
    islands = spans.groupBy(*KEY, "island").agg(F.min("run_id").alias("start"), F.max("run_id").alias("end"), F.count("*").alias("n"), F.min("no").alias("from_no"), F.max("no").alias("to_no"), F.max("last_no").alias("last_no"), F.max("gap").alias("gap"))
    keys = islands.groupBy(*KEY).agg(
        F.min("start").alias("first_seen"),
        F.max("end").alias("last_seen"),
        F.sum("n").alias("runs_seen"),
        (F.count("*") - 1).alias("absences"),
        F.max("gap").cast("long").alias("longest_absence"),
        F.max("to_no").alias("_to"),
        F.max("from_no").alias("_from"),
        F.max("last_no").alias("_last"),
    )
    status = F.when(F.col("_to") < F.col("_last"), "gone").when(F.col("_from") < F.col("_last"), "present").when(F.col("absences") > 0, "returned").otherwise("new")
    return keys.select(*KEY, "first_seen", "last_seen", "runs_seen", "absences", "longest_absence", status.alias("status"))


def key_changes(sightings: DataFrame, keep: str) -> DataFrame:
    """What happened to each key of ``sightings`` (``KEY``, ``at`` timestamp,
    payload): (``KEY``, at, status, payload).

    ``added`` where the key was not seen for ``keep`` (an interval of days or
    less) before, ``changed`` where its payload is another than at its last
    sighting, ``removed`` at the end of ``keep`` after a sighting that none
    followed until then, if the newest sighting of all is that late.  Of several
    payloads of one time the greatest counts.  ``streaming.drift.follow`` gives
    the same rows from a stream."""
    from pyspark.sql import Window

    once = sightings.groupBy(*KEY, "at").agg(F.max("payload").alias("payload"))
    newest = sightings.agg(F.max("at").alias("newest"))  # one row
    own = Window.partitionBy(*KEY).orderBy("at")
    until = F.expr(f"at + INTERVAL {keep}")
    rows = once.withColumns({"before": F.lag("at").over(own), "was": F.lag("payload").over(own), "next": F.lead("at").over(own), "until": until}).crossJoin(F.broadcast(newest))
    fresh = F.col("before").isNull() | (F.col("before") + F.expr(f"INTERVAL {keep}") < F.col("at"))
    event = lambda at, status, payload: F.struct(at.alias("at"), F.lit(status).alias("status"), payload.alias("payload"))
    gone = (F.col("next").isNull() | (F.col("next") > F.col("until"))) & (F.col("until") < F.col("newest"))
    events = F.array(
        F.when(fresh, event(F.col("at"), "added", F.col("payload"))).when(~F.col("payload").eqNullSafe(F.col("was")), event(F.col("at"), "changed", F.col("payload"))),
        F.when(gone, event(F.col("until"), "removed", F.col("payload"))),
    )
    return rows.select(*KEY, F.explode(F.array_compact(events)).alias("e")).select(*KEY, "e.at", "e.status", "e.payload")


def gates(changes: DataFrame, providers: list[str], names: list[str]) -> DataFrame:
    """(repo, gate) of the gates that fail: new-model, new-tool,
    new-external-provider.  Unknown names are ignored."""
    added = changes.where("status = 'added'")
    rules = {
        "new-model": F.col("section") == "models",
        "new-tool": F.col("section") == "tools",
        "new-external-provider": (F.col("section") == "models") & F.col("key").isin(providers),
    }
    hits = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items() if name in names], F.lit(None).cast("string")))
    return added.select("repo", F.explode(hits).alias("gate")).distinct()


def scan_gates(counts: DataFrame, max_high_risk: int | None = None, max_unsupported: int | None = None) -> DataFrame:
    """(repo, gate) where a count is above its limit."""
    limits = {"max-high-risk": ("high_or_critical_risks", max_high_risk), "max-unsupported": ("unsupported_artifacts", max_unsupported)}
    hits = [F.when(F.col(c) > n, F.lit(name)) for name, (c, n) in limits.items() if n is not None]
    return counts.select("repo", F.explode(F.array_compact(F.array(*hits, F.lit(None).cast("string")))).alias("gate"))


#: counts of a repository, in the order of a summary
COUNTS = ["models", "tools", "datasets", "frameworks", "prompts", "unsupported_artifacts", "high_or_critical_risks"]


def repo_summary(repos: DataFrame, counts: DataFrame, errors: DataFrame) -> DataFrame:
    """(repo, status, counts, error): a repository whose ingest failed, by
    ``errors`` (repo, reason), is a row, not a failed job; of several reasons the
    least is named."""
    reasons = errors.groupBy("repo").agg(F.min("reason").alias("error"))
    out = repos.select("repo").distinct().join(counts, "repo", "left").join(reasons, "repo", "left")
    return out.withColumn("status", F.when(X.known("error").isNotNull(), "error").otherwise("ok"))


def scan_summary(repos: DataFrame, counts: DataFrame, errors: DataFrame, failed: DataFrame) -> DataFrame:
    """One row for each repository: repo, status, error, ``COUNTS``,
    ``gate_verdict`` and ``gate_failures``, sorted and distinct.

    ``counts`` are those of ``section_counts``, ``failed`` (repo, gate) are gates
    that didn't hold.  A repository that could not be scanned has zeros, the
    verdict ``fail`` and the one failure ``scan-error``."""
    gates_of = failed.groupBy("repo").agg(F.sort_array(F.collect_set("gate")).alias("gate_failures"))
    rows = repo_summary(repos, counts, errors).join(gates_of, "repo", "left")
    ok = F.col("status") == "ok"
    found = F.when(ok, F.coalesce("gate_failures", F.array().cast("array<string>"))).otherwise(F.array(F.lit("scan-error")))
    numbers = [F.when(ok, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c) for c in COUNTS]
    return rows.select("repo", "status", "error", *numbers, F.when(F.size(found) == 0, "pass").otherwise("fail").alias("gate_verdict"), found.alias("gate_failures"))


def rollup(summary: DataFrame, organisation: Column) -> DataFrame:
    """Totals of ``scan_summary`` by ``organisation`` and section, by organisation
    and over all: (organisation, section, level, repositories, failed, total,
    gate_verdict), in one aggregation over grouping sets.

    ``level`` is ``section``, ``organisation`` or ``all``; what a row sums over is
    null.  ``failed`` counts repositories that did not pass, and a group passes
    if all of them do."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("n")) for c in COUNTS])).alias("cell")
    rows = summary.select(organisation.alias("organisation"), "repo", "gate_verdict", cells).select("organisation", "repo", "gate_verdict", "cell.section", "cell.n")
    lead = F.col("section") == COUNTS[0]  # one of a repository's cells counts it
    found = rows.groupingSets([["organisation", "section"], ["organisation"], []], "organisation", "section").agg(
        F.when(F.grouping("organisation") == 1, "all").when(F.grouping("section") == 1, "organisation").otherwise("section").alias("level"),
        F.count_if(F.lit(True)).alias("cells"),
        F.count_if(lead).alias("heads"),
        F.count_if(F.col("gate_verdict") == "fail").alias("failed_cells"),
        F.count_if((F.col("gate_verdict") == "fail") & lead).alias("failed_heads"),
        F.sum("n").alias("total"),
    )
    one = F.col("level") == "section"
    failed = F.when(one, F.col("failed_cells")).otherwise(F.col("failed_heads"))
    return found.select("organisation", "section", "level", F.when(one, F.col("cells")).otherwise(F.col("heads")).alias("repositories"), failed.alias("failed"), "total", F.when(failed > 0, "fail").otherwise("pass").alias("gate_verdict"))
