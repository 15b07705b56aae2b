"""Rebuilding conversations from message rows (problem 3).

Rows are an event log.  The first row of a ``uuid`` creates a message, later rows
of it are retries; a row whose ``subtype`` is 'edit' replaces the content of its
uuid, one whose ``subtype`` is 'delete' takes the message away.  ``fold`` brings
the log to one row per message by version; the folded rows are put in order and
validated (``faults``), and the messages of sound sessions become turns, in which
the rows of one assistant message id are parts of one message.

A session may hold a third of all rows, so nothing is ordered session by session
in one task: rows are range-partitioned by session and place, which cuts long
sessions, each range (``cell``) is ordered by itself, and only one row per cell
is ordered per session.

Defined results: session ids agree but for case and outer white space of any
kind; rows with a null session id belong to none; rows with a null uuid are
messages of their own; ties go by ``rec_id``; sessions without rows are
``empty``; null and blank roles are empty roles; a table without sessions gives
no rows; of several edits the last counts, a deleted message counts as never
written whatever else its uuid holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import materialize

_SPACE = r"(?U)^\s+|\s+$"


def session_key(c: Column) -> Column:
    """Session ids compared without case and outer white space."""
    return F.lower(F.regexp_replace(c, _SPACE, ""))


def event_rows(records: DataFrame) -> DataFrame:
    """The event log: what folding, ordering and validation need of each record; texts stay behind."""
    has_text = F.exists(
        F.col("message.content"),
        lambda b: (F.coalesce(b["type"], F.lit("")) == "text") & (F.regexp_replace(F.coalesce(b["text"], F.lit("")), r"(?U)\s+", "") != ""),
    )
    person = F.col("rec_type").isin("user", "assistant")
    speaks = person & ~F.coalesce("is_meta", F.lit(False)) & ~F.coalesce("is_api_error", F.lit(False)) & F.coalesce(has_text, F.lit(False))
    return records.select(
        session_key(F.col("session_id")).alias("session_id"), "rec_id",
        F.coalesce("uuid", F.concat(F.lit("row "), F.col("rec_id").cast("string"))).alias("uuid"),
        F.col("record_index").cast("long").alias("record_index"), "ts", F.col("message.id").alias("message_id"),
        F.when(F.col("subtype").isin("edit", "delete"), F.col("subtype")).alias("op"),
        F.when(speaks & (F.col("rec_type") == "user"), "prompt").when(speaks, "reply").alias("part"),
        (person & (F.coalesce(F.regexp_replace("message.role", r"(?U)\s+", ""), F.lit("")) == "")).alias("no_role"),
        F.expr(
            "transform(filter(transform(message.content, (b, i) -> struct(i as block_no, b.type as type, b.id as id, b.tool_use_id as ref)),"
            " x -> x.type in ('tool_use', 'tool_result')), x -> x)"
        ).alias("tools"),
    ).where("session_id is not null")


def in_cells(rows: DataFrame, order: list, label: str, cells: int | None = None) -> DataFrame:
    """rows(session_id, ...) written in ranges of (session_id, *order), with ``cell``, the number of the range.

    Ranges are balanced by a sample of the rows, so a long session falls into
    many cells; ``cells`` sets their number, else the session's shuffle settings do.
    """
    by = ["session_id", *order]
    spread = rows.repartitionByRange(cells, *by) if cells else rows.repartitionByRange(*by)
    return materialize(spread.withColumn("cell", F.spark_partition_id()), label)


def placed(rows: DataFrame, cells: int | None = None) -> DataFrame:
    """rows(session_id, uuid, rec_id, record_index, ts, ...) with ``pos`` and ``sub``.

    Rows stand by (pos, sub, rec_id): pos is the record index; a row without one
    follows the last indexed row whose time isn't later (sub is its time).
    """
    indexed, late = rows.where("record_index is not null"), rows.where("record_index is null")
    # The times of late rows and of first copies; the running maximum of the index
    # over time is found per cell, then over one row per cell.
    marks = indexed.groupBy("session_id", "uuid").agg(F.min("record_index").alias("idx"), F.min_by("ts", "record_index").alias("ts")).where("ts is not null").select(
        "session_id", "ts", "idx", F.lit(None).cast("long").alias("late_id")
    ).join(late.select("session_id").distinct(), "session_id", "left_semi")
    both = marks.unionByName(late.select("session_id", "ts", F.lit(None).cast("long").alias("idx"), F.col("rec_id").alias("late_id")))
    both = in_cells(both, ["ts", "late_id"], "conv-late", cells)
    within = Window.partitionBy("session_id", "cell").orderBy("ts", F.col("late_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("session_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy("session_id", "cell").agg(F.max("idx").alias("top")).withColumn("carried", F.max("top").over(before)).drop("top")
    stood = (
        both.withColumn("own", F.max("idx").over(within)).where("late_id is not null").join(carry, ["session_id", "cell"])
        .select("session_id", F.col("late_id").alias("rec_id"), F.greatest("own", "carried").alias("after"))
    )
    late = late.join(stood, ["session_id", "rec_id"], "left").withColumn("pos", F.coalesce("after", F.lit(-1).cast("long"))).withColumn("sub", F.coalesce(F.unix_micros("ts"), F.lit(0))).drop("after")
    return indexed.withColumn("pos", F.col("record_index")).withColumn("sub", F.lit(-1).cast("long")).unionByName(late)


def fold(sessions: DataFrame, records: DataFrame, cells: int | None = None) -> DataFrame:
    """The event log of the wanted sessions folded to one row per living message, in cells, with ``n_versions``.

    A message stands where its first row stands; its content is that of its last
    edit, else of the first row.
    """
    log = placed(event_rows(records).join(_wanted(sessions), "session_id", "left_semi"), cells)
    at = F.struct(*_ORDER)
    # Most messages have one row, so only the others are folded and joined.
    versions = log.groupBy("session_id", "uuid").agg(
        F.count("*").alias("n_versions"), F.min(at).alias("at"), F.max(F.when(F.col("op") == "edit", at))["rec_id"].alias("edit_id"), F.max(F.coalesce(F.col("op") == "delete", F.lit(False))).alias("deleted"),
    ).where("n_versions > 1")
    rows = log.join(versions, ["session_id", "uuid"], "left").where(
        "not coalesce(deleted, op <=> 'delete') and (n_versions is null or rec_id = coalesce(edit_id, at.rec_id))"
    )
    stands = {c: F.coalesce(F.col("at")[c], F.col(c)) for c in ("pos", "sub")} | {"first_id": F.coalesce("at.rec_id", "rec_id")}
    rows = rows.withColumns(stands).withColumn("n_versions", F.coalesce("n_versions", F.lit(1).cast("long"))).drop("at", "edit_id", "deleted", "op", "record_index")
    return in_cells(rows.withColumnRenamed("rec_id", "content_id").withColumnRenamed("first_id", "rec_id"), _ORDER, "conv-folded", cells)


def _wanted(sessions: DataFrame) -> DataFrame:
    return sessions.select(session_key(F.col("session_id")).alias("session_id")).where("session_id is not null").distinct()


_ORDER = ["pos", "sub", "rec_id"]


def validate(sessions: DataFrame, folded: DataFrame) -> DataFrame:
    """(session_id, fault): empty, headless, unanswered and broken sessions, from the folded rows in order."""
    said = folded.where("part is not null")
    in_cell = Window.partitionBy("session_id", "cell").orderBy(*_ORDER)
    per_cell = said.withColumn("next", F.lead("part").over(in_cell)).groupBy("session_id", "cell").agg(
        F.min(F.struct(*_ORDER, "part"))["part"].alias("head"), F.max(F.struct(*_ORDER, "part"))["part"].alias("tail"),
        F.max((F.col("part") == "prompt") & (F.coalesce("next", F.lit("")) == "prompt")).alias("double"),
    )
    over = Window.partitionBy("session_id").orderBy("cell")
    spoken = per_cell.withColumn("next", F.lead("head").over(over)).groupBy("session_id").agg(
        F.min(F.struct("cell", "head"))["head"].alias("head"),
        F.max(F.col("double") | ((F.col("tail") == "prompt") & (F.coalesce("next", F.lit("prompt")) == "prompt"))).alias("open"),
    )
    # A result is orphaned if the earliest result of its id has no earlier use.
    tools = folded.where("size(tools) > 0").select("session_id", *_ORDER, F.inline("tools"))
    at = F.struct(*_ORDER, "block_no")
    used, got = F.min(F.when(F.col("type") == "tool_use", at)), F.min(F.when(F.col("type") == "tool_result", at))
    ref = F.when(F.col("type") == "tool_use", F.col("id")).otherwise(F.col("ref"))
    orphans = tools.withColumn("ref", ref).where("ref is not null").groupBy("session_id", "ref").agg(used.alias("used"), got.alias("got")).where("got is not null and (used is null or used > got)").select("session_id")
    broken = folded.where("no_role").select("session_id").unionByName(orphans).distinct().withColumn("broken", F.lit(True))

    checked = _wanted(sessions).join(spoken, "session_id", "left").join(broken, "session_id", "left")
    found = F.array_compact(F.array(
        F.when(F.col("head").isNull(), "empty"), F.when(F.col("head") == "reply", "headless"),
        F.when(F.col("open"), "unanswered"), F.when(F.col("broken"), "broken"),
    ))
    return checked.select("session_id", F.explode(found).alias("fault"))


def faults(sessions: DataFrame, records: DataFrame, cells: int | None = None) -> DataFrame:
    """(session_id, fault) of all sessions: the event log folded, ordered and validated."""
    return validate(sessions, fold(sessions, records, cells))


def conversations(sessions: DataFrame, records: DataFrame, cells: int | None = None, drop_faulty: bool = True) -> DataFrame:
    """The messages of sound sessions in order, one row per final message.

    (session_id, turn_no, message_no, speaker, uuid, ts, n_versions, text): turn 0
    is what stands before the first prompt; the rows of one assistant message id
    are parts of the first of them; ``n_versions`` counts all rows of the log that
    a message was folded from; API errors and meta rows are left out.
    """
    folded = fold(sessions, records, cells)
    said = folded.where("part is not null").drop("tools")
    if drop_faulty:
        said = said.join(validate(sessions, folded).select("session_id").distinct(), "session_id", "left_anti")
    body = records.select(
        F.col("rec_id").alias("content_id"), session_key(F.col("session_id")).alias("session_id"),
        F.array_join(F.expr("transform(filter(message.content, b -> b.type = 'text' and b.text is not null), b -> b.text)"), "\n").alias("text"),
    )
    rows = said.join(body, ["session_id", "content_id"])
    key = F.coalesce(F.when(F.col("part") == "reply", F.col("message_id")), F.col("uuid"))
    messages = rows.groupBy("session_id", key.alias("message_key"), "part").agg(
        F.min(F.struct(*_ORDER, "cell", "uuid", "ts")).alias("at"), F.sum("n_versions").alias("n_versions"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_ORDER, "text"))), lambda x: x["text"]), "\n").alias("text"),
    ).select("session_id", "at.*", "part", "n_versions", "text")
    # Two-level running counts: inside a cell, then over the cells' totals.
    inside = Window.partitionBy("session_id", "cell").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    is_prompt = (F.col("part") == "prompt").cast("long")
    before = Window.partitionBy("session_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    total = messages.groupBy("session_id", "cell").agg(F.count("*").alias("m"), F.sum(is_prompt).alias("p")).select(
        "session_id", "cell", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0")
    )
    numbered = messages.withColumn("m", F.count("*").over(inside)).withColumn("p", F.sum(is_prompt).over(inside))
    return numbered.join(total, ["session_id", "cell"]).select(
        "session_id", (F.col("p") + F.col("p0")).alias("turn_no"), (F.col("m") + F.col("m0")).alias("message_no"),
        F.when(F.col("part") == "prompt", "user").otherwise("assistant").alias("speaker"), "uuid", "ts", "n_versions", "text",
    )
