"""Behaviour patterns in the order of a session's records; frames count all records, meta and tool rows included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import patterns as P
from threadloom.functions import text as T
from threadloom.operators.evidence import evidence_text, parts_of, trajectory_text
from threadloom.operators.ordered import CHUNK, frame, running, with_halo


def _marked(rows: DataFrame) -> DataFrame:
    uses = F.coalesce(F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b: F.coalesce(b["name"], F.lit("Unknown tool"))), F.array().cast("array<string>"))
    errors = F.coalesce(F.exists("blocks", lambda b: (b["type"] == "tool_result") & F.coalesce(b["is_error"], F.lit(False))), F.lit(False))
    return rows.select(
        "session_id", "i", "rec_id", "type", "text", uses.alias("tools"), ((F.col("type") == "user") & errors).alias("tool_error")
    )


def detect(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(session_id, i, rec_id, kind, score): verification, correction, repetition, clarification and scope findings.

    ``correction`` looks at the next assistant text however far behind; it is
    found from the chunk's first such text and the first of later chunks.
    """
    m = _marked(rows)
    says = F.when((F.col("type") == "assistant") & (F.col("text") != ""), F.col("text"))
    m = m.withColumn("said", says).withColumn("said_i", F.when(F.col("said").isNotNull(), F.col("i")))
    h = with_halo(m, 7, 6, chunk)
    checks = F.exists("tools", lambda t: F.lower(t).rlike(P.VERIFY_TOOL))
    last_tool = F.when(F.size("tools") > 0, F.element_at("tools", -1))
    h = h.withColumns({
        "verified": F.max(checks.cast("int")).over(frame(-7, 0)), "failed": F.last(last_tool, True).over(frame(-3, -1)),
        "later": F.flatten(F.collect_list("tools").over(frame(1, 6))), "soon": F.first("said", True).over(frame(1, 4)),
        "answer": F.last(F.when(F.col("own"), F.col("said")), True).over(Window.partitionBy("session_id", "chunk").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)),
    }).where("own")
    heads = m.where("said is not null").withColumn("chunk", F.expr(f"i div {chunk}")).groupBy("session_id", "chunk").agg(F.min_by("said", "i").alias("head"))
    # From behind, so that each row takes one step: the first text of any later chunk.
    chunks = m.select("session_id", F.expr(f"i div {chunk}").alias("chunk")).distinct().join(heads, ["session_id", "chunk"], "left").withColumn(
        "beyond", F.last("head", True).over(Window.partitionBy("session_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1))
    ).drop("head")
    h = h.join(chunks, ["session_id", "chunk"]).withColumn("answer", F.coalesce("answer", "beyond"))
    t, user, agent = F.col("text"), F.col("type") == "user", F.col("type") == "assistant"
    out: list[Column] = []

    def found(order: int, kind: str, score: Column | float, when: Column) -> None:
        s = score if isinstance(score, Column) else F.lit(score)
        out.append(F.when(when, F.struct(F.lit(order).alias("check_no"), F.lit(kind).alias("kind"), s.alias("score"))))

    found(1, "verification", 0.72, agent & T.matches(t, P.COMPLETION) & (F.col("verified") == 0))
    found(2, "correction", F.when(T.matches(F.col("answer"), P.APOLOGY), 0.81).otherwise(0.58), user & T.matches(t, P.PUSHBACK) & F.col("answer").isNotNull())
    found(3, "repetition", 0.66, F.col("tool_error") & F.col("failed").isNotNull() & F.array_contains("later", F.col("failed")))
    found(4, "clarification", 0.76, user & T.matches(t, P.RISK) & F.coalesce(F.col("soon").contains("?"), F.lit(False)) & T.matches(F.col("soon"), P.SCOPE_QUESTION))
    found(5, "scope", 0.61, agent & T.matches(t, P.EXPANSION))
    return h.select("session_id", "i", "rec_id", F.inline(F.array_compact(F.array(*out))))


def top_findings(findings: DataFrame, rows: DataFrame, per_kind: int = 3) -> DataFrame:
    """The first findings of each kind: sessions by latest start, then record order."""
    starts = rows.groupBy("session_id").agg(F.min("ts").alias("started_at"))
    order = Window.partitionBy("kind").orderBy(F.col("started_at").desc_nulls_last(), "session_id", "i", "check_no")
    return findings.join(starts, "session_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_kind).select(
        "kind", "place", "session_id", "i", F.substring(F.sha2(F.concat_ws("|", "session_id", "i", "kind"), 256), 1, 16).alias("finding_id"),
        T.confidence_label(F.col("score")).alias("confidence"),
    )


def excerpts(findings: DataFrame, rows: DataFrame, before: int = 1, after: int = 2, most: int = 520) -> DataFrame:
    """The user and assistant texts around a finding as evidence, one row per record."""
    near = findings.select("session_id", F.col("i").alias("center"), "kind", F.explode(F.sequence(F.col("i") - before, F.col("i") + after)).alias("i"))
    texts = rows.where("type in ('user', 'assistant') and text <> ''").select("session_id", "i", "type", "text").join(near.select("session_id", "i").distinct(), ["session_id", "i"])
    shown = texts.select("session_id", "i", "type", evidence_text(F.col("text"), most).alias("excerpt"))
    return near.join(shown, ["session_id", "i"]).select("session_id", "center", "kind", "i", "type", "excerpt")


# ---- blockers and their context ---------------------------------------------

_EVENT = "array<struct<part:int,role:string,kind:string,action:string,method:string,summary:string>>"


def trajectory(rows: DataFrame) -> DataFrame:
    """Events of each session in order, numbered from 0 by ``ordinal``: texts in parts fit to be shown, tool uses and tool results.

    Texts of meta records are left out; a text of which nothing can be shown is
    one ``content_removed`` event; a session without events has one placeholder;
    ``model`` is the last one named, before any the agent's default.
    """
    prose = F.when(~F.col("is_meta") & F.col("type").isin("user", "assistant", "system") & (F.col("text") != ""), trajectory_text(F.col("text")))
    cut = rows.withColumn("__prose", prose).withColumn("__parts", F.filter(parts_of(F.col("__prose")), lambda p: T.trajectory_safe(p)))
    role = F.when(F.col("type").isin("assistant", "system"), F.col("type")).otherwise("user")
    none = F.lit(None).cast("string")

    def event(part: Column, role: Column, kind: Column, summary: Column, action: Column = none, method: Column = none) -> Column:
        return F.struct(part.cast("int").alias("part"), role.alias("role"), kind.alias("kind"), action.alias("action"), method.alias("method"), summary.alias("summary"))

    said = F.transform("__parts", lambda p, k: event(k, role, F.concat(role, F.lit("_text")), p))
    removed = F.array(event(F.lit(0), role, F.lit("content_removed"), F.lit("Message content removed locally")))
    texts = F.when(F.col("__prose").isNull(), F.array().cast(_EVENT)).when(F.size("__parts") > 0, said).otherwise(removed)

    def of_block(b: Column, k: Column) -> Column:
        s = T.tool_semantics(b["name"], b["input"])
        use = b["type"] == "tool_use"
        result = F.coalesce(T.restriction(b["content"]), F.when(F.coalesce(b["is_error"], F.lit(False)), "error").otherwise("completed"))
        label = F.concat(F.lit("Tool use: "), T.tool_label(b["name"]), F.coalesce(F.concat(F.lit(" ("), s["action"], F.lit(")")), F.lit("")))
        return event(k + 1000, F.when(use, "assistant").otherwise("tool"), b["type"], F.when(use, label).otherwise(F.concat(F.lit("Tool result: "), result)), F.when(use, s["action"]), F.when(use, s["method"]))

    tools = F.filter(F.transform("blocks", of_block), lambda e: e["kind"].isin("tool_use", "tool_result"))
    events = F.concat(texts, F.coalesce(tools, F.array().cast(_EVENT)))
    named = F.when((F.col("model") != "<synthetic>"), F.col("model"))
    each = cut.select("session_id", "i", "agent", "ts", named.alias("named"), events.alias("events")).withColumn("n", F.size("events"))
    placed = running(each, sums={"upto": F.col("n").cast("long")}, lasts={"model": F.col("named")})
    model = F.coalesce("model", F.when(F.col("agent") == "codex", "Codex model").otherwise("Claude model"))
    out = placed.select("session_id", "i", "ts", model.alias("model"), (F.col("upto") - F.col("n")).alias("base"), F.posexplode("events").alias("k", "e")).select(
        "session_id", "i", "ts", "model", (F.col("base") + F.col("k")).alias("ordinal"), "e.role", "e.kind", "e.action", "e.method", "e.summary"
    )
    bare = each.groupBy("session_id").agg(F.sum("n").alias("n"), F.min_by("agent", "i").alias("agent")).where("n = 0").select(
        "session_id", F.lit(None).cast("long").alias("i"), F.lit(None).cast("timestamp").alias("ts"), F.when(F.col("agent") == "codex", "Codex model").otherwise("Claude model").alias("model"), F.lit(0).cast("long").alias("ordinal"),
        F.lit("system").alias("role"), F.lit("content_removed").alias("kind"), none.alias("action"), none.alias("method"), F.lit("No share-safe trajectory content").alias("summary"),
    )
    return out.unionByName(bare)


def trajectory_coverage(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: trajectories, events and chunks."""
    return events.agg(F.count_distinct("session_id").alias("trajectories"), F.count("*").alias("events")).crossJoin(chunks.agg(F.count("*").alias("chunks")))


def valid_chunks(chunks: DataFrame, events: DataFrame, most: int = 160) -> DataFrame:
    """(session_id, part_index, valid): whether a chunk may be judged, i.e. numbers in range, events without gap, known kinds and roles, texts fit to be shown."""
    from threadloom.functions.patterns import ACTIONS, METHODS

    tool = F.col("kind") == "tool_use"
    ok = (
        F.col("role").isin("user", "assistant", "system", "tool") & F.col("kind").isin("user_text", "assistant_text", "system_text", "tool_use", "tool_result", "content_removed")
        & (F.col("action").isNull() | tool & F.col("action").isin(ACTIONS)) & (F.col("method").isNull() | tool & F.col("method").isin(METHODS)) & T.trajectory_safe(F.col("summary"))
    )
    got = chunk_events(chunks, events).groupBy("session_id", "part_index").agg(F.count("*").alias("n"), F.min(ok).alias("ok"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    size = F.col("to_event") - F.col("from_event")
    return chunks.join(got, ["session_id", "part_index"], "left").select(
        "session_id", "part_index",
        F.coalesce(F.col("ok") & F.col("part_index").between(1, F.col("part_count")) & size.between(1, most) & (F.col("n") == size) & (F.col("lo") == F.col("from_event")) & (F.col("hi") == F.col("to_event") - 1), F.lit(False)).alias("valid"),
    )


def blocker_windows(events: DataFrame, before: int = 16, after: int = 15) -> DataFrame:
    """Merged event ranges [start, end) around blockers, per session."""
    size = events.groupBy("session_id").agg((F.max("ordinal") + 1).alias("size"))
    b = events.where((F.col("kind") == "tool_result") & T.matches(F.col("summary"), P.BLOCKER)).join(size, "session_id").select(
        "session_id", "ordinal", F.greatest(F.lit(0), F.col("ordinal") - before).alias("start"), F.least(F.col("size"), F.col("ordinal") + after).alias("end")
    )
    w = Window.partitionBy("session_id").orderBy("ordinal")
    # Windows have one width, so a gap to the one before starts a new group.
    b = b.withColumn("fresh", (F.col("start") > F.coalesce(F.lag("end").over(w), F.lit(-1))).cast("int")).withColumn("grp", F.sum("fresh").over(w))
    return b.groupBy("session_id", "grp").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("blockers")).drop("grp")


def window_chunks(windows: DataFrame, size: int = 160, overlap: int = 12) -> DataFrame:
    """Windows cut into parts of at most ``size`` events that share ``overlap``; numbered per session."""
    step = size - overlap
    starts = F.expr(f"sequence(start, start + {step} * greatest(0, cast(ceil((end - start - {size}) / {step}.0) as bigint)), {step})")
    parts = windows.select("session_id", F.explode(starts).alias("from_event"), "end").withColumn("to_event", F.least(F.col("from_event") + size, F.col("end"))).drop("end")
    return parts.withColumn("part_index", F.row_number().over(Window.partitionBy("session_id").orderBy("from_event"))).withColumn(
        "part_count", F.count("*").over(Window.partitionBy("session_id"))
    )


def chunk_events(chunks: DataFrame, events: DataFrame, cell: int = 128) -> DataFrame:
    """The events of each chunk: a range join through cells, so that it stays an equi-join."""
    cells = chunks.withColumn("cell", F.explode(F.expr(f"sequence(from_event div {cell}, (to_event - 1) div {cell})")))
    return cells.join(events.withColumn("cell", F.expr(f"ordinal div {cell}")), ["session_id", "cell"]).where("ordinal >= from_event and ordinal < to_event").select(
        "session_id", "part_index", "ordinal", "role", "kind", "action", "method", "summary"
    )


def batches(chunks: DataFrame, events: DataFrame, most_chunks: int = 12, most_bytes: int = 150_000) -> DataFrame:
    """Chunks put greedily into batches of at most ``most_chunks`` and ``most_bytes`` of JSON, session by session."""
    sized = chunk_events(chunks, events).groupBy("session_id", "part_index").agg(F.sum(F.octet_length(F.to_json(F.struct("ordinal", "kind", "action", "method", "summary")))).alias("bytes"))
    ordered = sized.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("part_index", F.col("bytes").cast("long").alias("bytes")))).alias("parts"))
    fold = F.expr(f"""
      aggregate(parts, struct(0 as n, 0L as used, 0 as batch, cast(array() as array<struct<part_index:int,batch:int>>) as done),
        (a, x) -> case when a.n > 0 and (a.n >= {most_chunks} or a.used + x.bytes > {most_bytes})
          then struct(1 as n, x.bytes as used, a.batch + 1 as batch, concat(a.done, array(struct(x.part_index as part_index, a.batch + 1 as batch))) as done)
          else struct(a.n + 1 as n, a.used + x.bytes as used, a.batch as batch, concat(a.done, array(struct(x.part_index as part_index, a.batch as batch))) as done) end,
        a -> a.done)""")
    return ordered.select("session_id", F.inline(fold))
