"""Column functions.  All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from stocktake import constants as C

#: the line ends that Python's ``splitlines`` knows
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """Null for null, empty and ``unknown`` values."""
    return F.nullif(F.nullif(col(c), F.lit("")), F.lit(C.UNKNOWN))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def path_parts(path: Column | str) -> Column:
    return F.split(col(path), "/")


def file_name(path: Column | str) -> Column:
    return F.element_at(path_parts(path), -1)


def suffix(path: Column | str) -> Column:
    """Last suffix of the file name, with its dot; empty for ``.env`` and the like."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def is_ignored(path: Column | str, folders: Sequence[str] = C.IGNORED_DIRS) -> Column:
    return F.arrays_overlap(path_parts(path), F.array(*map(F.lit, folders)))


def decoded(content: Column | str) -> Column:
    """Text of UTF-8 bytes with plain line ends; null if they are no UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(col(content).cast("string")), "\r\n?", "\n")


def lines(text: Column | str) -> Column:
    """Lines of a text without their ends; none after a last line end."""
    parts = F.split(col(text), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def unquoted(value: Column) -> Column:
    """Value without blanks, then double, then single quotes around it."""
    return F.btrim(F.btrim(F.btrim(value, F.lit(" \t\n\r\x0b\x0c")), F.lit('"')), F.lit("'"))


def line_pairs(text: Column | str) -> Column:
    """Array of (key, value) of the lines ``key: value``."""
    pattern = r"^\s*([A-Za-z0-9_\-]+)\s*:\s*(.+?)\s*$"
    hits = F.filter(lines(text), lambda x: x.rlike(pattern))
    return F.transform(hits, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("key"), unquoted(F.regexp_extract(x, pattern, 2)).alias("value")))


def env_pairs(text: Column | str) -> Column:
    """Array of (key, value) of the lines ``KEY=value`` that are no comments."""
    trimmed = F.transform(lines(text), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c")))
    hits = F.filter(trimmed, lambda x: ~x.startswith("#") & x.contains("="))
    return F.transform(hits, lambda x: F.struct(F.btrim(F.regexp_extract(x, r"^([^=]*)=", 1)).alias("key"), unquoted(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)).alias("value")))


def literal_in(line: Column, least: int = 1) -> Column:
    """First double-quoted literal of a line, or the sentinel for none."""
    found = F.regexp_extract(line, '"([^"]+)"', 1)
    return F.when(F.length(found) >= least, found).otherwise(F.lit(C.UNKNOWN if least == 1 else C.REDACTED))


def first_group(text: Column, pattern: str, default: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found).otherwise(F.lit(default))


def image_refs(text: Column | str) -> Column:
    """Sorted distinct image references with a digest."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(text), F.lit(C.IMAGE_REF), 1)))


def masked(key: Column, value: Column) -> Column:
    """``key=[masked:ab***yz hash:12 hex digits]``; up to four letters vanish."""
    n = F.length(value)
    stars = F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), F.greatest(n - 4, F.lit(1))), F.right(value, F.lit(2))))
    return F.concat(key, F.lit("=[masked:"), stars, F.lit(" hash:"), F.left(F.sha2(value, 256), F.lit(12)), F.lit("]"))


def config_evidence(key: Column, value: Column, strict: bool = False) -> Column:
    """Evidence of a setting; credentials, or with ``strict`` all, are masked."""
    secret = F.lower(key).isin(C.SENSITIVE_KEYS) | F.lit(strict)
    return F.when(F.coalesce(value, F.lit("")) == "", key).when(secret, masked(key, value)).otherwise(F.concat(key, F.lit("="), F.left(value, F.lit(80))))


def slug(c: Column) -> Column:
    safe = F.btrim(F.regexp_replace(c, "[^A-Za-z0-9.-]+", "-"), F.lit("-"))
    return F.when(F.coalesce(safe, F.lit("")) == "", F.lit(C.UNKNOWN)).otherwise(safe)


def spdx_id(prefix: Column, *parts: Column) -> Column:
    """Readable parts and ten digits of the hash of all; null parts are empty."""
    whole = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    readable = [F.when(p != "", slug(p)) for p in whole]
    return F.concat_ws("-", F.concat(F.lit("SPDXRef-"), slug(prefix)), *readable, F.left(F.sha2(F.concat_ws("::", *whole), 256), F.lit(10)))


def bom_ref(kind: Column, name: Column, version: Column, source: Column, prefix: str = "asset-") -> Column:
    seed = F.concat_ws(":", kind, name, version, F.coalesce(source, F.lit("")))
    return F.concat(F.lit(prefix), F.left(F.sha2(seed, 256), F.lit(16)))


def stable_seed(artifact: Column, commit: Column, document: Column) -> Column:
    """What a document's identifiers come from: its hash, or its commit where it
    has none, unless that is a placeholder; else the hash of its text."""
    given = F.coalesce(F.nullif(artifact, F.lit("")), F.nullif(commit, F.lit("")))
    return F.coalesce(F.nullif(given, F.lit("DYNAMIC")), F.sha2(document, 256))


def uuid5(name: Column) -> Column:
    """Version 5 UUID of a name in the namespace of URLs (RFC 4122)."""
    h = F.sha1(F.concat(F.unhex(F.lit(C.URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def risk_source(risk_id: Column) -> Column:
    """Source file at the end of a finding's id; empty with fewer than three parts."""
    parts = F.split(risk_id, ":")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(F.lit(""))


def vex_status(severity: Column) -> Column:
    return F.when(severity == "high", "affected").when(severity == "medium", "under_investigation").otherwise("not_affected")


def severity_of(score: Column) -> Column:
    out = reduce(lambda c, band: c.when(score >= band[0], band[1]), C.SEVERITY_BANDS[1:], F.when(score >= C.SEVERITY_BANDS[0][0], C.SEVERITY_BANDS[0][1]))
    return out.otherwise("low")


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for low, 4 for others."""
    ranks = F.create_map(*[F.lit(x) for pair in C.SEVERITY_RANKS.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.lower(severity)), F.lit(4))


def is_severe(severity: Column) -> Column:
    return F.lower(severity).isin("high", "critical")


def confidence_of(signals: Sequence[Column]) -> Column:
    """high for two signals or more, medium for one, low for none."""
    n = reduce(lambda a, b: a + b, [F.when(s, 1).otherwise(0) for s in signals], F.lit(0))
    return F.when(n >= 2, "high").when(n == 1, "medium").otherwise("low")


def normal_timestamp(text: Column) -> Column:
    """Compact or ISO time as ISO with Z, anything else the epoch."""
    found = F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return F.coalesce(F.date_format(found, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z"))


def license_verdict(name: Column) -> Column:
    """unknown, copyleft, unlisted or ok."""
    normal = F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    copyleft = any_of([normal.contains(x) for x in C.LICENSES_COPYLEFT])
    return F.when((normal == "") | (F.upper(normal) == "UNKNOWN"), "unknown").when(copyleft, "copyleft").when(normal.isin(C.LICENSES_ALLOWED), "ok").otherwise("unlisted")


def _escaped(char: Column) -> Column:
    """A character as JSON writes it in ASCII: one or two units of UTF-16."""
    code = F.ascii(char)
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
    return F.when(code < 0x7F, char).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))


#: control characters whose escapes have a letter among their digits
_LETTERED = [n for n in range(0x20) if f"{n:x}" != f"{n:X}" and n not in (0x0A, 0x0C, 0x0D)]


def ascii_json(text: Column) -> Column:
    """A JSON text with all that is no ASCII escaped, surrogate pairs for what is
    beyond the basic plane, and escapes in small letters.  Outside of strings JSON
    is ASCII, so the value stays the same."""
    chars = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), _escaped)
    found = F.when(text.rlike("[^\\x00-\\x7e]"), F.array_join(chars, "")).otherwise(text)
    small = found
    for n in _LETTERED:  # an escape begins behind an even number of backslashes
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*)\\u{n:04X}", rf"$1\\u{n:04x}")
    return F.when(found.contains("\\u00"), small).otherwise(found)


def _in_order(value: Column, kind: DataType) -> Column:
    """A value whose fields and keys, at any depth, are sorted by name."""
    if isinstance(kind, StructType):
        fields = [_in_order(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _in_order(x, kind.elementType))
    if isinstance(kind, MapType):
        pairs = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k.alias("key"), _in_order(F.try_element_at(value, k), kind.valueType).alias("value")))
        return F.map_from_entries(pairs)
    return value


def canonical(value: Column, kind: DataType) -> Column:
    """The canonical JSON text of a struct, array or map: keys sorted, no blanks,
    nulls written, ASCII only.  Equal values have equal texts, so its hash stands
    for the value and its order is that of the text.  Map keys are strings."""
    return ascii_json(F.to_json(_in_order(value, kind), {"ignoreNullFields": "false"}))
