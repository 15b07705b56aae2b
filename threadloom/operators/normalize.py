"""Dialect normalisers: enveloped transcripts with cumulative counters, and logs with replays and split messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.ordered import ranked, running
from threadloom.session import materialize

_USAGE = ["input_tokens", "output_tokens", "cache_write_input_tokens", "cached_input_tokens"]
_ENVELOPE = (
    "timestamp string, type string, payload struct<type:string,id:string,forked_from_id:string,parent_thread_id:string,cwd:string,model:string,role:string,content:string,"
    "name:string,call_id:string,arguments:string,input:string,output:string,info:struct<total_token_usage:struct<"
    + ",".join(f"{c}:double" for c in _USAGE) + ">>>"
)
_ELIGIBLE = ["copy", "delete", "download", "edit", "hide", "install", "link", "mount", "move", "search", "write"]


def envelopes(lines: DataFrame) -> DataFrame:
    """lines(session_id, line_no, raw) -> parsed envelopes with exact rank ``i`` over the usable lines."""
    e = lines.where(F.col("raw").rlike(r"^\s*\{")).withColumn("e", F.from_json("raw", _ENVELOPE)).where("e.type is not null")
    rows = e.select(
        "session_id", F.col("line_no").cast("long").alias("record_index"), F.col("line_no").alias("rec_id"), F.expr("try_to_timestamp(e.timestamp)").alias("ts"),
        F.col("e.timestamp").alias("ts_raw"), "e.type", "e.payload",
    )
    return ranked(rows)


def forward_fill_model(rows: DataFrame) -> DataFrame:
    """Envelopes with the model in force: the last declared, before any the session's first, else 'Codex model'."""
    declared = F.when(F.col("type") == "turn_context", F.col("payload.model"))
    first = rows.where(declared.isNotNull()).groupBy("session_id").agg(F.min_by(declared, "i").alias("first_model"))
    return running(rows, lasts={"model": declared}).join(first, "session_id", "left").withColumn(
        "model", F.coalesce("model", "first_model", F.lit("Codex model"))
    ).drop("first_model")


def usage_deltas(rows: DataFrame) -> DataFrame:
    """(session_id, i, components): differences of cumulative counters, never below 0; rows without any are dropped.

    In forked sessions rows before the first turn context only move the baseline.
    """
    total = F.col("payload.info.total_token_usage")
    tok = rows.where((F.col("type") == "event_msg") & (F.col("payload.type") == "token_count") & total.isNotNull()).select(
        "session_id", "i", F.col("i").alias("record_index"), F.col("i").alias("rec_id"), "ts", *(F.coalesce(total[c], F.lit(0.0)).cast("long").alias(c) for c in _USAGE)
    )
    n = ranked(tok.withColumnRenamed("i", "at"))
    prior = n.select("session_id", (F.col("i") + 1).alias("i"), *(F.col(c).alias(f"__{c}") for c in _USAGE))
    d = n.join(prior, ["session_id", "i"], "left").select(
        "session_id", F.col("at").alias("i"), *(F.greatest(F.lit(0), F.col(c) - F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in _USAGE)
    )
    start = rows.groupBy("session_id").agg(
        F.max((F.coalesce("payload.forked_from_id", "payload.parent_thread_id", F.lit("")) != "") & (F.col("type") == "session_meta")).alias("forked"), F.min(F.when(F.col("type") == "turn_context", F.col("i"))).alias("first_turn")
    )
    d = d.join(start, "session_id").where(~F.col("forked") | (F.col("first_turn").isNotNull() & (F.col("i") >= F.col("first_turn")))).drop("forked", "first_turn")
    d = d.where(" + ".join(_USAGE) + " > 0")
    return d.withColumnsRenamed({"cache_write_input_tokens": "cache_creation_input_tokens", "cached_input_tokens": "cache_read_input_tokens"})


def call_pairs(rows: DataFrame) -> DataFrame:
    """(session_id, i, call_i, tool, action, method): each tool output with the call it answers.

    By id: the latest call of the id before the output, each call once.  Calls
    without id wait in a queue that outputs without id take from; an output that
    finds the queue empty takes nothing.
    """
    call = F.col("payload.type").isin("function_call", "custom_tool_call")
    out = F.col("payload.type").isin("function_call_output", "custom_tool_call_output")
    ev = rows.where((F.col("type") == "response_item") & (call | out)).select(
        "session_id", "i", call.alias("is_call"), F.nullif("payload.call_id", F.lit("")).alias("call_id"), F.col("payload.name").alias("tool"), F.coalesce("payload.arguments", "payload.input").alias("arguments"), "payload.output"
    )
    named, anon = ev.where("call_id is not null"), ev.where("call_id is null")
    named = named.withColumn("prev_call", F.lag(F.when(F.col("is_call"), F.struct("i", "tool", "arguments"))).over(Window.partitionBy("session_id", "call_id").orderBy("i")))
    paired = named.where("not is_call").select("session_id", "i", F.col("prev_call.i").alias("call_i"), F.col("prev_call.tool").alias("tool"), F.col("prev_call.arguments").alias("arguments"), "output")
    # The queue's length is the running sum of calls less outputs, lifted by its lowest point so far;
    # an output at a new lowest point finds it empty.
    w = Window.partitionBy("session_id").orderBy("i")
    step = anon.withColumn("s", F.sum(F.when(F.col("is_call"), 1).otherwise(-1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.least(F.lit(0), F.coalesce(F.min("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    k = step.withColumn("void", ~F.col("is_call") & (F.col("s") < low)).withColumn("k", F.row_number().over(Window.partitionBy("session_id", "is_call", "void").orderBy("i")))
    outs = k.where("not is_call").select("session_id", F.when(~F.col("void"), F.col("k")).alias("k"), "i", "output")
    lone = outs.join(k.where("is_call").select("session_id", "k", F.col("i").alias("call_i"), "tool", "arguments"), ["session_id", "k"], "left").select(
        "session_id", "i", "call_i", "tool", "arguments", "output"
    )
    both = paired.unionByName(lone)
    s = T.tool_semantics(F.col("tool"), F.col("arguments"))
    return both.select("session_id", "i", "call_i", "tool", F.when(F.col("call_i").isNotNull(), s["action"]).alias("action"), F.when(F.col("call_i").isNotNull(), s["method"]).alias("method"), "output")


def output_errors(pairs: DataFrame) -> DataFrame:
    """Pairs with is_error and error_summary, from wrappers, exit codes and restriction phrases."""
    is_array = F.col("output").rlike(r"^\s*\[")
    parts = F.when(is_array, F.transform(F.from_json("output", "array<struct<text:string>>"), lambda p: F.coalesce(p["text"], F.lit(""))))
    text = F.coalesce(F.array_join(parts, "\n"), F.col("output"), F.lit(""))
    wrapped = F.coalesce(F.exists(parts, lambda t: t.rlike(r"(?i)^\s*Script (?:completed|failed)(?![0-9A-Za-z_])")), F.lit(False))
    failed = F.coalesce(F.exists(parts, lambda t: t.rlike(r"(?i)^\s*Script failed(?![0-9A-Za-z_])") | (F.coalesce(F.get_json_object(t, "$.exit_code").try_cast("int"), F.lit(0)) != 0)), F.lit(False))
    p = pairs.withColumns({"text": text, "wrapped": wrapped, "failed": failed})
    eligible = F.col("failed") | (~F.col("wrapped") & F.coalesce(F.col("action").isin(_ELIGIBLE), F.lit(False)))
    p = p.withColumn("error_summary", F.when(eligible, T.restriction(F.col("text"), sudo=True)))
    return p.withColumn("is_error", F.col("error_summary").isNotNull() | F.col("failed") | (~F.col("wrapped") & F.col("text").rlike("(?i)(error|failed|failure)"))).drop("text", "wrapped", "failed", "output")


def replay_dedup(rows: DataFrame) -> DataFrame:
    """Rows without replays and without later rows of a uuid in the session, of the kept types; a uuid is taken before the type filter."""
    live = rows.where(~F.coalesce(F.col("is_replay"), F.lit(False)))
    first = live.where("coalesce(uuid, '') <> ''").groupBy("session_id", "uuid").agg(F.min("rec_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return live.join(first, ["session_id", "uuid"], "left").where("first_id is null or first_id = rec_id").drop("first_id").where("rec_type in ('user', 'assistant', 'system')")


def merge_split_messages(rows: DataFrame) -> DataFrame:
    """Rows of one assistant message id become one: blocks of later rows that the first doesn't hold follow, last usage, first model.

    rows(session_id, i, type, message_id, model, usage, blocks).
    """
    key = F.coalesce(F.when(F.col("type") == "assistant", F.col("message_id")), F.concat(F.lit("row "), F.col("i").cast("string")))
    has_usage = F.col("usage").isNotNull()
    g = rows.withColumn("blocks_json", F.transform("blocks", lambda b: F.to_json(b))).groupBy("session_id", key.alias("key")).agg(
        F.min("i").alias("i"), F.first("type").alias("type"), F.count("*").alias("n_rows"), F.max_by("usage", F.when(has_usage, F.col("i"))).alias("usage"),
        F.min_by("model", F.when(F.coalesce("model", F.lit("")) != "", F.col("i"))).alias("model"),
        F.array_sort(F.collect_list(F.struct("i", "blocks_json"))).alias("parts"),
    )
    head = F.coalesce(F.expr("parts[0].blocks_json"), F.array().cast("array<string>"))
    tail = F.expr("aggregate(slice(parts, 2, size(parts)), cast(array() as array<string>), (a, p) -> concat(a, filter(coalesce(p.blocks_json, cast(array() as array<string>)), b -> not array_contains(coalesce(parts[0].blocks_json, cast(array() as array<string>)), b) and not array_contains(a, b))))")
    return g.select("session_id", "i", "type", "n_rows", "usage", "model", F.concat(head, tail).alias("blocks_json"))


def normalized(lines: DataFrame) -> DataFrame:
    """Enveloped lines as records in input order: texts, tool calls, outputs, usage and interrupts, densely numbered."""
    # Every line is parsed and ranked once.
    rows = forward_fill_model(materialize(envelopes(lines), "envelopes"))
    content = F.from_json("payload.content", "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(content, lambda b: b["type"].isin("input_text", "output_text", "text") & b["text"].isNotNull()), lambda b: b["text"])
    base = rows.withColumn("texts", F.when((F.col("type") == "response_item") & (F.col("payload.type") == "message"), F.coalesce(texts, F.when(F.col("payload.content").rlike(r"^[^\[]"), F.array("payload.content")))))
    blank = {"text": None, "tool": None, "action": None, "method": None, "error_summary": None}

    def shape(df: DataFrame, kind: str, **cols) -> DataFrame:
        filled = blank | cols
        return df.select("session_id", "i", "ts_raw", "model", F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), *((F.lit(None).cast("string") if v is None else v).alias(k) for k, v in filled.items()))

    said = shape(base.where("size(texts) > 0"), F.when(F.col("payload.role") == "assistant", "assistant").otherwise("user"), text=F.array_join("texts", "\n"))
    s = T.tool_semantics(F.col("payload.name"), F.coalesce("payload.arguments", "payload.input"))
    calls = shape(base.where("type = 'response_item' and payload.type in ('function_call', 'custom_tool_call')"), "tool_use", tool=F.col("payload.name"), action=s["action"], method=s["method"])
    outs = output_errors(call_pairs(rows)).join(base.select("session_id", "i", "ts_raw", "model"), ["session_id", "i"])
    outs = shape(outs, F.when(F.col("is_error"), "tool_error").otherwise("tool_result"), tool=F.col("tool"), action=F.col("action"), method=F.col("method"), error_summary=F.col("error_summary"))
    stops = shape(base.where("type = 'event_msg' and payload.type = 'turn_aborted'"), "interrupt")
    used = usage_deltas(rows).join(base.select("session_id", "i", "ts_raw", "model"), ["session_id", "i"])
    used = shape(used, "usage", text=F.to_json(F.struct("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")))
    all_rows = said.unionByName(calls).unionByName(outs).unionByName(stops).unionByName(used)
    renum = ranked(all_rows.withColumns({"record_index": F.col("i"), "rec_id": F.col("i"), "ts": F.lit(None).cast("timestamp")}).withColumnRenamed("i", "line"))
    return renum.drop("record_index", "rec_id", "ts")


def as_records(normal: DataFrame) -> DataFrame:
    """Normalised lines as the ordered rows every analysis reads: one row per message with its blocks.

    Tool calls carry what they did as ``action`` and ``method``, results whether
    they failed and why; usage stands on a system row, an interrupt too.
    """
    block = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean,thinking:string>"
    null = F.lit(None).cast("string")

    def one(kind: str, text=null, name=null, content=null, is_error=None):
        e = F.lit(None).cast("boolean") if is_error is None else is_error
        return F.array(F.struct(F.lit(kind).alias("type"), text.alias("text"), null.alias("id"), name.alias("name"), null.alias("input"), null.alias("tool_use_id"), content.alias("content"), e.alias("is_error"), null.alias("thinking")))

    k = F.col("kind")
    blocks = (
        F.when(k.isin("user", "assistant"), one("text", text=F.col("text"))).when(k == "tool_use", one("tool_use", name=F.coalesce("tool", F.lit("Unknown tool"))))
        .when(k.isin("tool_result", "tool_error"), one("tool_result", content=F.col("error_summary"), is_error=k == "tool_error")).otherwise(F.array().cast(f"array<{block}>"))
    )
    usage = F.when(k == "usage", F.from_json("text", "input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint"))
    kind = F.when(k.isin("user", "tool_result", "tool_error"), "user").when(k.isin("assistant", "tool_use"), "assistant").otherwise("system")
    return normal.select(
        "session_id", F.col("i").alias("rec_id"), null.alias("uuid"), F.lit("codex").alias("agent"), kind.alias("type"), F.expr("try_to_timestamp(ts_raw)").alias("ts"), k.isin("tool_result", "tool_error").alias("is_meta"),
        F.lit(False).alias("is_api_error"), F.lit(False).alias("is_replay"), null.alias("cwd"), F.when(k == "interrupt", "interrupt").alias("subtype"), F.when(k == "interrupt", "interrupt").alias("sys_content"),
        F.when(k.isin("assistant", "tool_use", "usage"), F.col("model")).alias("model"), null.alias("message_id"), usage.alias("usage"), F.when(k.isin("user", "assistant"), T.trimmed(F.col("text"))).otherwise("").alias("text"), blocks.alias("blocks"), "i", "action", "method",
    )
