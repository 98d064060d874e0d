"""Detectors: from files to facts.

A fact is one row: ``repo, detector, ordinal, place, rel_path, seq, kind, name,
value, source_file, endpoint, category, severity, confidence``.

kind         name                  value
file                               scanned, or seen if it could not be read
model        type                  model
dataset      type
tool         name
prompt       id                    template
framework    name
finding      id                    evidence
context      field of the context  value
unsupported  type of the artifact

``ordinal`` is that of the detector, ``place`` orders its files, ``seq`` the
facts of a file; together they say which fact came first.

All detectors share one pass: a file becomes a row for each detector that reads
it, one vectorised function parses what needs a parser, and one expression for
each detector turns the row into all its facts.  Nothing is shuffled here, and
each file is read once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake import constants as C
from stocktake.functions import columns as X
from stocktake.functions.parsers import parsed_texts

FACT = ["kind", "name", "value", "source_file", "endpoint", "category", "severity", "confidence"]
COLUMNS = ["repo", "detector", "ordinal", "place", "rel_path", "seq", *FACT]
CustomDetector = Callable[[DataFrame], DataFrame]
STEP = 1_000_000  # facts of one line, cell or pair


def fact(kind: str, name: Column, value: Column | None = None, source: Column | None = None, endpoint: Column | None = None, category: Column | None = None, severity: Column | None = None, confidence: Column | None = None) -> Column:
    parts = [F.lit(kind), name, value, source, endpoint, category, severity, confidence]
    return F.struct(*[(F.lit(None) if p is None else p).cast("string").alias(n) for p, n in zip(parts, FACT, strict=True)])


def _finding(name: Column, category: str | Column, source: Column, severity: str | Column, confidence: str | Column, evidence: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return fact("finding", name, evidence, source, None, lit(category), lit(severity), lit(confidence))


def _concat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@dataclass(frozen=True)
class Detector:
    """Which files are read (a condition on name, suffix and rel_path), how they
    are ordered, what is parsed (language and texts, null for nothing), which are
    scanned beyond being readable, and their facts: an array of (seq, fact)."""

    reads: Column
    by_part: bool
    facts: Column
    language: str | None = None
    texts: Column | None = None
    scanned: Column | None = None


def _numbered(facts: Column, base: Column | int = 0) -> Column:
    """(seq, fact) of an array, ``seq`` from ``base`` on."""
    start = F.lit(base) if isinstance(base, int) else base
    return F.transform(facts, lambda f, i: F.struct((start.cast("long") * STEP + i).alias("seq"), f.alias("fact")))


def _spread(items: Column, facts: Callable[[Column, Column], Column], first: int = 0) -> Column:
    """(seq, fact) of every item of an array."""
    return F.flatten(F.transform(items, lambda x, i: _numbered(facts(x, i), i + first)))


# ---- which files a detector reads ----


def _text() -> Column:
    return F.col("text")


def _path() -> Column:
    return F.col("rel_path")


def _name() -> Column:
    return F.col("name")


def _suffix() -> Column:
    return F.col("suffix")


def _is_json() -> Column:
    return F.lower(_suffix()) == ".json"


def _events() -> Column:
    return F.col("parsed")[0]["events"]


def _hinted() -> Column:
    parts = F.transform(X.path_parts("rel_path"), F.lower)
    return F.lower(_suffix()).isin(C.MANIFEST_SUFFIXES) & F.arrays_overlap(parts, F.array(*map(F.lit, C.MANIFEST_FOLDERS)))


# ---- line detectors: Java, Go, C# ----


def _line_facts(language: str) -> Column:
    """Facts of each line, by patterns alone."""
    spec = C.LINE_LANGUAGES[language]

    def of(line: Column, row: Column) -> Column:
        source = _concat(_path(), ":", (row + 1).cast("string"))
        facts = []
        if spec["import"]:
            imported = F.lower(F.regexp_extract(line, spec["import"], 1))
            facts += [F.when(imported.contains(k), fact("framework", F.lit(v))) for k, v in spec["frameworks"].items()]
        else:
            quoted = F.lower(F.regexp_extract(line, '"([^"]+)"', 1))
            facts += [F.when(quoted == k, fact("framework", F.lit(v))) for k, v in spec["frameworks"].items()]
        for pattern, kind, endpoint in spec["models"]:
            evidence = f"{spec['label']} model usage detected: {kind}."
            facts.append(F.when(line.rlike(pattern), fact("model", F.lit(kind), X.literal_in(line), source, F.lit(endpoint))))
            facts.append(F.when(line.rlike(pattern), _finding(_concat(f"{spec['prefix']}-model:{kind}:", source), "model invocation", source, "medium", "medium", F.lit(evidence))))
        facts.append(F.when(X.any_of([line.rlike(p) for p in spec["tools"]]), fact("tool", X.first_group(line, spec["tool_name"], spec["tool_default"]), None, source)))
        facts.append(F.when(X.any_of([line.rlike(p) for p in spec["prompts"]]), fact("prompt", source, X.literal_in(line, 4), source)))
        return F.array(*facts)

    # most lines match nothing: one pattern decides which are looked at
    telling = [p for p, _, _ in spec["models"]] + spec["tools"] + spec["prompts"] + [spec["import"] or '"[^"]+"']
    any_fact = "|".join(f"(?:{p})" for p in telling)
    lines = F.filter(F.transform(X.lines(_text()), lambda x, i: F.struct(x.alias("line"), i.alias("row"))), lambda x: x["line"].rlike(any_fact))
    return F.flatten(F.transform(lines, lambda x: _numbered(of(x["line"], x["row"]), x["row"])))


# ---- Python and notebooks ----


def _python_facts(e: Column, source: Column, findings: bool) -> Column:
    """Facts of one event of the Python parser."""
    kind, name = e["kind"], e["name"]
    endpoints = F.create_map(*[F.lit(x) for pair in C.PY_ENDPOINTS.items() for x in pair])
    aliases = F.create_map(*[F.lit(x) for pair in C.FRAMEWORK_ALIASES.items() for x in pair])
    framework = F.try_element_at(aliases, name)
    facts = [
        F.when((kind == "import") & framework.isNotNull(), fact("framework", framework)),
        F.when(kind == "model", fact("model", name, e["value"], source, F.coalesce(F.try_element_at(endpoints, name), F.lit(C.UNKNOWN)))),
        F.when(kind == "tool", fact("tool", name, None, source)),
        F.when(kind == "dataset", fact("dataset", name, None, source)),
        F.when(kind == "prompt", fact("prompt", _concat(source, ":", e["line"].cast("string")), e["value"], source)),
    ]
    if findings:
        confidence = X.confidence_of([F.lit(True), e["imported"], e["configured"]])
        facts.append(F.when(kind == "model", _finding(_concat("python-model:", name, ":", source), "model invocation", source, "medium", confidence, _concat("Model class ", name, " detected in Python source."))))
    return F.array(*facts)


def notebook_cells(text: Column) -> Column:
    """(cell, source) of the code cells that are not blank."""
    cells = F.from_json(text, "struct<cells:array<struct<cell_type:string,source:variant>>>")["cells"]
    joined = lambda c: F.coalesce(F.array_join(F.try_variant_get(c["source"], "$", "array<string>"), ""), F.try_variant_get(c["source"], "$", "string"))
    numbered = F.transform(cells, lambda c, i: F.struct(i.alias("cell"), F.when(c["cell_type"] == "code", joined(c)).alias("source")))
    return F.filter(numbered, lambda c: F.btrim(c["source"]) != "")


def _notebook_facts() -> Column:
    cells = F.arrays_zip(F.col("cells").alias("c"), F.col("parsed").alias("p"))
    return F.flatten(F.transform(cells, lambda z: _numbered(F.flatten(F.transform(z["p"]["events"], lambda e: _python_facts(e, _concat(_path(), "#cell-", z["c"]["cell"].cast("string")), False))), z["c"]["cell"])))


# ---- JavaScript and TypeScript ----


def _script_fact(e: Column, source: Column) -> Column:
    kind, name, value = e["kind"], e["name"], e["value"]
    frameworks = F.create_map(*[F.lit(x) for pair in C.JS_FRAMEWORKS.items() for x in pair])
    endpoints = F.create_map(*[F.lit(x) for pair in C.JS_MODELS.items() for x in pair])
    framework = F.try_element_at(frameworks, name)
    model, full = F.substring_index(value, "\n", 1), F.substring_index(value, "\n", -1)
    imported = F.when(e["imported"], "True").otherwise("False")
    context = F.when(e["method"], "method").otherwise("function")
    plain = X.confidence_of([F.lit(True), e["imported"]])
    return F.array(
        F.when((kind == "import") & framework.isNotNull(), fact("framework", framework)),
        F.when(kind == "model", fact("model", name, model, source, F.try_element_at(endpoints, name))),
        F.when(kind == "model", _finding(_concat("js-ts-model:", name, ":", source), "model invocation", source, "medium", X.confidence_of([F.lit(True), e["imported"], e["configured"]]), _concat("JS/TS AST constructor detected: ", full, " (imported=", imported, ")."))),
        F.when(kind == "tool", fact("tool", name, None, source)),
        F.when(kind == "tool", _finding(_concat("js-ts-tool:", name, ":", source), "tool invocation", source, "low", plain, _concat("JS/TS AST call detected: ", value, " (context=", context, ")."))),
        F.when(kind == "prompt", fact("prompt", source, value, source)),
        F.when(kind == "prompt", _finding(_concat("js-ts-prompt:", source), "prompt template", source, "medium", plain, _concat("JS/TS AST prompt call detected: ", name, " (context=", context, ")."))),
    )


# ---- settings ----


def settings() -> Column:
    """(key, value) of the settings of a file: leaves of JSON, ``KEY=value`` of
    .env, lines ``key: value`` of all others."""
    return F.when(_name() == ".env", X.env_pairs(_text())).when(_is_json(), F.col("parsed")[0]["pairs"]).otherwise(X.line_pairs(_text()))


def _context_facts(key: Column, value: Column, tables: Sequence[dict[str, list[str]]] = (C.CONTEXT_KEYS, C.LINEAGE_KEYS)) -> list[Column]:
    out = []
    for field, keys in [(f, k) for t in tables for f, k in t.items()]:
        hit = key.isin(keys) & (value != "")
        if field == "model_artifact_digest":
            hit &= value.contains("sha256:")
        out.append(F.when(hit, fact("context", F.lit(field), value)))
    return out


def _config_facts(strict: bool) -> Column:
    hints = F.create_map(*[F.lit(x) for pair in C.CONFIG_HINTS.items() for x in pair])

    def of(pair: Column, _: Column) -> Column:
        low, value = F.lower(pair["key"]), pair["value"]
        category = F.try_element_at(hints, low)
        severity = F.when(category.contains("credential"), "high").otherwise("medium")
        confidence = X.confidence_of([F.lit(True), low.isin("model", "model_name", "provider")])
        return F.array(
            *_context_facts(low, value),
            F.when(category.isNotNull(), _finding(_concat("config:", low, ":", _path()), category, _path(), severity, confidence, X.config_evidence(pair["key"], value, strict))),
            F.when(low.isin("model", "model_name") & (value != ""), fact("model", F.lit("ConfigModelHint"), value, _path())),
            F.when((low == "provider") & (value != ""), fact("framework", F.lower(value))),
        )

    return _spread(settings(), of)


# ---- dependencies and manifests ----


def _matches(pattern: str) -> Column:
    return F.regexp_extract_all(_text(), F.lit(pattern), 1)


def _object_keys(field: str) -> Column:
    return F.coalesce(F.json_object_keys(F.get_json_object(_text(), f"$.{field}")), F.array().cast("array<string>"))


def dependencies() -> Column:
    """Distinct lower-case packages of Python manifests, lock files and charts,
    in their order."""
    low = F.lower(_name())
    wanted = F.transform(X.lines(_text()), lambda x: F.btrim(x))
    wanted = F.filter(wanted, lambda x: (x != "") & ~x.rlike("^[#-]"))
    wanted = F.transform(wanted, lambda x: F.btrim(F.regexp_extract(x, "^(.*?)(==|>=|<=|~=|!=|<|>|$)", 1)))
    found = (
        F.when(low.isin("requirements.txt", "requirements-dev.txt", "constraints.txt"), wanted)
        .when(low == "poetry.lock", _matches('name = "([^"]+)"'))
        .when(low.isin("uv.lock", "pdm.lock"), _matches(r'name\s*=\s*"([^"]+)"'))
        .when(low == "pyproject.toml", _matches(r'"([A-Za-z0-9_.-]+)\s*(?:==|>=|~=|\^|<|>)'))
        .when(low.isin("pdm.toml", "chart.yaml", "values.yaml"), _matches(r"(?m)^\s*name\s*:\s*([A-Za-z0-9_.-]+)"))
        .when(F.col("name") == "Pipfile.lock", _object_keys("default"))
        .when(F.col("name") == "package-lock.json", _object_keys("dependencies"))
    )
    return _distinct_deps(found)


def js_dependencies(strict_parity: bool = False) -> Column:
    """The same of package.json and the lock files of scripts.  ``strict_parity``
    reads lock files as if no package had a scope or a version folder."""
    sections = F.concat(*[_object_keys(s) for s in ("dependencies", "devDependencies", "peerDependencies")])
    yarn = r"(?m)^([^\s:@][^:\n]*?)@" if strict_parity else r'(?m)^"?((?:@[^\s/"]+/)?[^\s:@"]+)@'
    pnpm = r"(?m)^\s*/([^:@]+)" if strict_parity else r"(?m)^\s*/((?:@[^/\s]+/)?[^/:@\s]+)"
    pnpm_names = F.transform(_matches(pnpm), lambda x: F.substring_index(x, "/", -1)) if strict_parity else _matches(pnpm)
    found = F.when(F.col("name").isin("package.json", "package-lock.json"), sections).when(F.col("name") == "yarn.lock", _matches(yarn)).when(F.col("name") == "pnpm-lock.yaml", pnpm_names)
    return _distinct_deps(found)


def _distinct_deps(found: Column) -> Column:
    """Distinct in each file, by array functions: no shuffle."""
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda x: x != ""))


def _dependency_facts(prefix: str, label: str) -> Column:
    path = _path()
    aliases = F.create_map(*[F.lit(x) for pair in C.FRAMEWORK_ALIASES.items() for x in pair])
    listed = F.concat_ws(", ", F.slice(F.sort_array("deps"), 1, 10))
    one = F.when(F.size("deps") > 0, _finding(_concat(prefix, path), "dependency graph", path, "medium", "medium", _concat(f"Detected {label}: ", listed)))
    named = F.filter(F.transform("deps", lambda d: F.try_element_at(aliases, d)), lambda x: x.isNotNull())
    return _numbered(F.concat(F.array(one), F.transform(named, lambda x: fact("framework", x))))


def _manifest_facts(strict: bool) -> Column:
    """Dependencies, images, runtime settings and lineage of deployment files.

    Inside a file the image of ``FROM`` counts least, then the first image with
    a digest, then settings in order.
    """
    refs, path, docker = X.image_refs(_text()), _path(), F.lower(_name()).startswith("docker")
    base = F.regexp_extract(_text(), r"(?im)^\s*FROM\s+([^\s]+)", 1)
    base = F.when(docker & (base != ""), base)
    first = F.try_element_at(refs, F.lit(1))
    container = _finding(_concat("runtime-container:", path), "container metadata", path, "low", "medium", F.lit("Container/runtime metadata discovered."))
    images = F.concat(
        F.array(
            F.when(base.isNotNull(), fact("context", F.lit("immutable_version"), base)),
            F.when(base.contains("/"), fact("context", F.lit("registry_uri"), F.regexp_replace(base, ":[^:]*$", ""))),
            F.when(first.isNotNull(), fact("context", F.lit("immutable_version"), first)),
            F.when(first.isNotNull(), fact("context", F.lit("registry_uri"), F.substring_index(first, "@", 1))),
            F.when((F.size(refs) > 0) | docker, container),
        ),
        F.transform(refs, lambda r: _finding(_concat("runtime-image-digest:", path, ":", r), "immutable image digest", path, "low", "medium", _concat("Immutable OCI image reference detected: ", r))),
    )
    lineage_keys = sorted({k for ks in C.LINEAGE_KEYS.values() for k in ks})
    known = {f: C.CONTEXT_KEYS[f] for f in ("provider_endpoint", "immutable_version", "registry_uri")}
    runtime_keys = [k for ks in known.values() for k in ks]

    def of(pair: Column, _: Column) -> Column:
        low, value = F.lower(pair["key"]), pair["value"]
        runtime, lineage = low.rlike(C.RUNTIME_KEY) | low.isin(runtime_keys), low.isin(lineage_keys)
        evidence = X.config_evidence(low, value, strict)
        return F.array(
            *_context_facts(low, value, (known, _single_field(C.LINEAGE_KEYS))),
            F.when(lineage, _finding(_concat("runtime-lineage:", path, ":", low), "deployment lineage", path, "low", "medium", evidence)),
            F.when(runtime, _finding(_concat("runtime-ai-config:", path, ":", low), "runtime ai service config", path, "medium", "medium", evidence)),
            F.when(runtime | lineage, container),
        )

    return F.concat(_numbered(images), _spread(settings(), of, 1), F.when(F.size("deps") >= 0, _dependency_facts("runtime-deps:", "dependencies")).otherwise(F.array().cast(_FACTS)))


def _single_field(table: dict[str, list[str]]) -> dict[str, list[str]]:
    """The table with each key under the first field that has it."""
    seen: set[str] = set()
    return {field: [k for k in keys if not (k in seen or seen.add(k))] for field, keys in table.items()}


# ---- all of them ----

_FACTS = "array<struct<seq:bigint,fact:struct<" + ",".join(f"{n}:string" for n in FACT) + ">>>"


def detectors(strict: bool = False) -> dict[str, Detector]:
    """Detectors by source type, in the order in which their facts count."""
    own = F.array(_text())
    settings_file = F.when(_is_json(), own)
    scripts = lambda e: _script_fact(e, _concat(_path(), ":", e["line"].cast("string")))
    manifest = _name().isin(C.MANIFEST_NAMES) | F.lower(_name()).isin(C.DEPLOYMENT_NAMES) | _hinted()
    found = {
        "python": Detector(_suffix() == ".py", False, _numbered(F.flatten(F.transform(_events(), lambda e: _python_facts(e, _path(), True)))), "python", own, F.col("parsed")[0]["ok"]),
        "jupyter_notebook": Detector(_suffix() == ".ipynb", True, _notebook_facts(), "python", F.col("cells.source"), F.get_json_object(_text(), "$").startswith("{")),
        "config": Detector(_suffix().isin(".yaml", ".yml", ".json") | (_name() == ".env"), True, _config_facts(strict), "settings", settings_file),
        "runtime_manifest": Detector(manifest, True, _manifest_facts(strict), "settings", settings_file),
        "js_ts_manifest": Detector(_name().isin(C.JS_MANIFESTS), True, _dependency_facts("js-ts-deps:", "JS/TS dependencies")),
        "js_ts_ast": Detector(F.lower(_suffix()).isin(C.JS_SUFFIXES), False, _numbered(F.flatten(F.transform(_events(), scripts))), "script", own),
        **{language: Detector(_suffix() == spec["suffix"], False, _line_facts(language)) for language, spec in C.LINE_LANGUAGES.items()},
        "unsupported": Detector(F.lower(_suffix()) == ".toml", True, F.array().cast(_FACTS)),
    }
    assert [*found][:-1] == C.SOURCE_TYPES
    return found


@lru_cache(4)
def _expressions(application: str, strict: bool) -> dict[str, Detector]:
    """``detectors`` of a Spark application: expressions name columns, not tables,
    so they serve every table and are built once."""
    return detectors(strict)


def scan(files: DataFrame, strict: bool = False, runtime_manifests: bool = True, only: Sequence[str] | None = None) -> DataFrame:
    """Facts of the detectors over ``files`` (repo, rel_path, name, suffix, text),
    those of kind ``file`` and ``unsupported`` included; ``only`` names detectors.

    Null and empty texts give a ``file`` fact alone; repeated files give repeated
    facts; an empty table gives none."""
    known = _expressions(files.sparkSession.sparkContext.applicationId, strict)
    chosen = {n: d for n, d in known.items() if (only is None or n in only) and (n != "runtime_manifest" or runtime_manifests)}

    def cases(field: str) -> Column:
        picked = {n: getattr(d, field) for n, d in chosen.items()}
        return F.coalesce(*[F.when(F.col("detector") == n, F.lit(c) if isinstance(c, str) else c) for n, c in picked.items() if c is not None], F.lit(None))

    names = F.array_compact(F.array(*[F.when(d.reads, F.lit(n)) for n, d in chosen.items()]))
    rows = files.select("repo", "rel_path", "name", "suffix", "text", F.explode(names).alias("detector"))
    rows = rows.withColumn("read", F.coalesce(F.length("text") > 0, F.lit(False)))
    text = F.when(F.col("read"), _text())
    rows = rows.withColumn("cells", F.when(F.col("detector") == "jupyter_notebook", notebook_cells(text)))
    rows = rows.withColumn("deps", F.when(F.col("detector") == "runtime_manifest", dependencies()).when(F.col("detector") == "js_ts_manifest", js_dependencies()))
    rows = rows.withColumn("parsed", parsed_texts(cases("language"), F.when(F.col("read"), cases("texts"))))
    done = F.col("read") & F.coalesce(cases("scanned"), F.lit(True))
    head = F.when(F.col("detector") == "unsupported", fact("unsupported", F.lower(_suffix()), None, _path())).otherwise(fact("file", F.lit(""), F.when(done, "scanned").otherwise("seen"), _path()))
    head = F.array(F.struct(F.lit(-1).cast("long").alias("seq"), head.alias("fact")))
    found = F.when(F.col("read"), cases("facts"))
    every = F.explode(F.filter(F.concat(head, F.coalesce(found, F.array().cast(_FACTS))), lambda x: x["fact"].isNotNull())).alias("f")
    place = F.when(F.col("detector").isin([n for n, d in chosen.items() if d.by_part]), X.path_parts("rel_path")).otherwise(F.array("rel_path"))
    ordinal = F.array_position(F.array(*map(F.lit, C.SOURCE_TYPES)), F.col("detector")).cast("int") - 1
    return rows.select("repo", "detector", ordinal.alias("ordinal"), place.alias("place"), "rel_path", every).select("repo", "detector", "ordinal", "place", "rel_path", "f.seq", *[F.col(f"f.fact.{n}").alias(n) for n in FACT])


def all_facts(files: DataFrame, strict: bool = False, runtime_manifests: bool = True, extra: dict[str, CustomDetector] | None = None) -> DataFrame:
    """``scan``, and the facts of further detectors, each a function from files to
    rows with the columns ``COLUMNS``."""
    out = scan(files, strict, runtime_manifests)
    for detect in (extra or {}).values():
        out = out.unionByName(detect(files).select(*COLUMNS))
    return out


def unsupported(facts: DataFrame) -> DataFrame:
    """Files of known types that no detector covers."""
    found = facts.where("kind = 'unsupported'")
    return found.select("repo", F.col("rel_path").alias("path"), F.col("name").alias("artifact_type"), F.lit("No enabled detector covers this source artifact type.").alias("reason"))


def detector_coverage(facts: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """(repo, source_type, artifacts_seen, artifacts_scanned, default_confidence)
    for every repository and detector, zeros kept; ``repos`` names those that
    may have no fact.  A file counts as scanned if its text could be read, and
    parsed where that is needed."""
    counts = facts.where("kind = 'file'").groupBy("repo", F.col("detector").alias("source_type")).agg(F.count("*").alias("seen"), F.count_if(F.col("value") == "scanned").alias("scanned"))
    names = F.explode(F.array(*map(F.lit, C.SOURCE_TYPES))).alias("source_type")
    every = (facts if repos is None else repos).select("repo").distinct()
    full = every.select("repo", names).join(counts, ["repo", "source_type"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return full.select("repo", "source_type", n("seen").alias("artifacts_seen"), n("scanned").alias("artifacts_scanned"), F.lit("medium").alias("default_confidence"))
