"""Chat formatting with a grammar round trip, in DataFrame expressions only.

The template of a turn is ``### `` role ``: `` text `` </turn>`` and a line end; a
conversation is its turns in order.

Round one renders texts as they are and parses the rendering again: one open
mark, the role up to the first ``: ``, the text up to the close mark.  Where the
recovered turn differs from the source, or a text holds a backslash, round two
escapes: ``\\`` becomes ``\\\\``, ``##`` becomes ``#\\#`` and ``</turn>`` gets a ``\\``
inside, so no text holds a control string.  That is parsed and compared again; a
difference there is an error.  A backslash in a rendered turn thus says that it
is escaped.

The loss mask is stored with each turn: the span of the text of assistant turns
inside the rendered turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Level 1 of a text: reversible, and free of both control strings."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("##"), F.lit("#\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given: a backslash goes and what follows
    it stays, a second backslash included."""
    return F.regexp_replace(text, r"\\([\\#/])", "$1")


def _escape_role(role: Column) -> Column:
    """A role may hold anything but its own end; that is marked, too."""
    return F.replace(escape(role), F.lit(SEP), F.lit(":\\/ "))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(":\\/ "), F.lit(SEP)))


def _rendered(level: int) -> Column:
    role, text = F.col("role"), F.col("text")
    return F.concat(F.lit(OPEN), _escape_role(role) if level else role, F.lit(SEP), escape(text) if level else text, F.lit(CLOSE))


def _parsed(turn: Column, level: int) -> tuple[Column, Column]:
    """(role, text) by the grammar: the open mark, up to the first separator,
    and up to the close mark."""
    body = F.substring(turn, len(OPEN) + 1, 1 << 30)
    body = body.substr(F.lit(1), F.greatest(F.lit(0), F.length(body) - len(CLOSE)))
    role = F.substring_index(body, SEP, 1)
    text = body.substr(F.length(role) + len(SEP) + 1, F.length(body))
    return (_unescape_role(role), unescape(text)) if level else (role, text)


def _is_whole(turn: Column) -> Column:
    """Whether the parser finds exactly one turn: one open mark, at the start,
    and one close mark, at the end."""
    marks = F.size(F.split(turn, "###")) - 1
    ends = F.size(F.split(turn, "</turn>")) - 1
    return (marks == 1) & (ends == 1) & turn.startswith(OPEN) & turn.endswith(CLOSE)


def format_turns(conversations: DataFrame) -> DataFrame:
    """Rendered turns of ``conversations`` (conv_id, turn, role, text, any other
    columns): ``conv_id``, ``turn``, ``formatted``, ``level``, ``loss_start`` and
    ``loss_chars`` (0 outside assistant turns).

    Null roles and texts are empty.  Turns of a conversation go by turn, nulls
    first, ties by role and text; rows that are alike in all of them are
    separate turns.  Null conv_ids are one conversation.  The level is chosen
    for a turn's own grammar: since an escaped or clean turn holds its marks
    only where the template puts them, a conversation of such turns parses turn
    by turn, whatever its length, so no conversation is gathered here.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for level in (0, 1):
        role, text = _parsed(F.col(f"turn{level}"), level)
        same = _is_whole(F.col(f"turn{level}")) & (role == F.col("role")) & (text == F.col("text"))
        rows = rows.withColumn(f"turn{level}", _rendered(level)).withColumn(f"same{level}", same)
    # text without a backslash, too: at level 0 a backslash is plain, so a turn
    # that carries one must say so by its level
    clean = F.col("same0") & ~F.col("role").contains("\\") & ~F.col("text").contains("\\")
    failed = F.raise_error(F.concat(F.lit("turn does not survive its grammar: "), F.col("turn1")))
    rows = rows.withColumn("level", F.when(clean, 0).when(F.col("same1"), 1).otherwise(failed.cast("int")))
    formatted = F.when(F.col("level") == 0, F.col("turn0")).otherwise(F.col("turn1"))
    head = F.length(F.lit(OPEN)) + F.length(F.when(F.col("level") == 0, F.col("role")).otherwise(_escape_role(F.col("role")))) + len(SEP)
    trained = F.col("role") == TRAINED_ROLE
    return rows.select(
        "conv_id", "turn", formatted.alias("formatted"), "level",
        F.when(trained, head).otherwise(0).cast("int").alias("loss_start"),
        F.when(trained, F.length(formatted) - head - len(CLOSE)).otherwise(0).cast("int").alias("loss_chars"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, formatted) parsed from rendered
    turns alone.  A backslash marks level 1, so the level need not be kept.
    Repeated rows and null ids are rows like others, empty and very long texts
    come back whole; ``formatted`` is never null in what ``format_turns`` gave; an
    empty table gives no row."""
    escaped = F.col("formatted").contains("\\")
    plain, marked = _parsed(F.col("formatted"), 0), _parsed(F.col("formatted"), 1)
    span = F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_chars"))
    return formatted.select(
        "conv_id", "turn", "formatted",
        F.when(escaped, marked[0]).otherwise(plain[0]).alias("role"),
        F.when(escaped, marked[1]).otherwise(plain[1]).alias("text"),
        F.when(F.col("loss_chars") > 0, F.when(escaped, unescape(span)).otherwise(span)).otherwise("").alias("loss_text"),
    )


def conversations_of(formatted: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` is its whole text, turns in order,
    those of one turn number by their text, repeated rows repeated.  Null ids are
    one conversation; an empty table gives none.  A conversation is gathered in
    one task, as its text is one value."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "formatted")))
    return formatted.groupBy("conv_id").agg(F.concat_ws("", listed.getField("formatted")).alias("formatted"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) parsed from whole conversations (conv_id,
    formatted) alone.  No turn holds a close mark but at its end, so cutting
    behind each mark gives the turns; ``place`` counts them from 0.  A null or
    empty conversation gives no turn, null ids stay null, repeated rows give
    repeated turns; an empty table gives no row."""
    parts = F.split("formatted", " </turn>\n")
    rows = conversations.select("conv_id", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("place", "part"))
    turn = F.concat("part", F.lit(CLOSE))
    plain, marked = _parsed(turn, 0), _parsed(turn, 1)
    escaped = turn.contains("\\")
    return rows.select("conv_id", "place", F.when(escaped, marked[0]).otherwise(plain[0]).alias("role"), F.when(escaped, marked[1]).otherwise(plain[1]).alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation: ``n_turns``, ``turns_sha256``, ``loss_chars``,
    ``loss_sha256``, ``formatted_chars`` of parsed turns, in the order of turn
    numbers, then roles and texts, so that ties have one order.  Repeated rows
    count each; null ids are one conversation; an empty table gives no row."""
    item = F.struct("turn", "role", "text", "loss_text", F.length("formatted").alias("chars"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    each = F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.concat_ws("", F.transform("t", lambda x: x["loss_text"]))
    return rows.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", each), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["chars"]).alias("formatted_chars"),
    )
