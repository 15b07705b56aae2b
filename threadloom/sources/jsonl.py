"""Newline-delimited JSON transcripts of several dialects as one DataFrame of lines and records.

Files are read as splittable text; a line's place is (start of its split, number
inside the split), so a file of any size is numbered without being read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import normalize
from threadloom.operators.ordered import ranked

DIALECTS = ("claude", "codex", "cowork")
_CONTENT = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean,thinking:string>>"
_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
_RECORD = (
    "type string, uuid string, sessionId string, timestamp string, cwd string, isMeta boolean, isReplay boolean, isApiErrorMessage boolean,"
    " subtype string, content string, _audit_timestamp string, message struct<role:string,model:string,id:string,content:string,usage:" + _USAGE + ">"
)


def read_lines(spark: SparkSession, paths: str | list[str], pattern: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """(file, file_size, modified_at, line_no, raw) of all text files below the paths; blank lines keep their number."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).text(paths)
    placed = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__id"), F.regexp_replace("value", "\r$", "").alias("raw"),
    )
    inside = Window.partitionBy("file", "__split").orderBy("__id")
    before = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    start = placed.groupBy("file", "__split").agg(F.count("*").alias("n")).select("file", "__split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return placed.withColumn("__rn", F.row_number().over(inside)).join(start, ["file", "__split"]).select(
        "file", "file_size", "modified_at", (F.col("__start") + F.col("__rn") - 1).alias("line_no"), "raw"
    )


def discover(spark: SparkSession, root: str, agent: str) -> DataFrame:
    """Lines of one dialect: claude files lie two levels deep, codex files anywhere, cowork logs in local_* folders."""
    if agent == "claude":
        return read_lines(spark, f"{root}/*/*.jsonl", recursive=False).withColumn("agent", F.lit(agent))
    lines = read_lines(spark, root)
    if agent == "cowork":
        lines = lines.where(F.col("file").rlike(r"/local_[^/]*/audit\.jsonl$"))
    return lines.withColumn("agent", F.lit(agent))


def discover_all(spark: SparkSession, claude: str | None = None, codex: list[str] = (), cowork: str | None = None) -> DataFrame:
    """Lines of all dialects below their roots; codex may have several. Roots that don't exist are passed over."""
    roots = [("claude", r) for r in [claude] if r] + [("codex", r) for r in codex] + [("cowork", r) for r in [cowork] if r]
    found = [discover(spark, r, a) for a, r in roots if _exists(spark, r)]
    if not found:
        return spark.createDataFrame([], "file string, file_size bigint, modified_at timestamp, line_no bigint, raw string, agent string")
    return reduce(DataFrame.unionByName, found)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def session_of(file: Column) -> Column:
    """A session's id: an opaque one of its file."""
    return T.opaque_id(file)


_CANONICAL = ["session_id", "rec_id", "uuid", "agent", "type", "ts", "is_meta", "is_api_error", "is_replay", "cwd", "subtype", "sys_content", "model", "message_id", "usage", "text", "blocks", "i"]


def read_records(lines: DataFrame) -> DataFrame:
    """Lines of any dialects (file, line_no, raw, agent) as ordered rows under one schema, the one all analyses read.

    Claude's records stay as they are; of cowork's replays, repeats and split
    messages are undone; codex's envelopes become messages.  Rows are numbered from
    0 within a session; lines that are no JSON object are dropped.
    """
    lines = lines.withColumn("session_id", session_of(F.col("file")))
    plain = lines.where("agent <> 'codex'")
    r = message_records(plain.drop("session_id")).withColumn("session_id", session_of(F.col("file")))
    r = r.withColumns({"record_index": F.col("line_no"), "rec_id": F.col("line_no")})
    kept = normalize.replay_dedup(r.where("agent = 'cowork'")).unionByName(r.where("agent = 'claude'"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    shaped = kept.select(
        "session_id", "record_index", "rec_id", "uuid", "agent", F.col("rec_type").alias("type"), "ts", flag("is_meta"), flag("is_api_error"), flag("is_replay"), "cwd", "subtype", F.col("content").alias("sys_content"),
        F.col("message.model").alias("model"), F.col("message.id").alias("message_id"), F.col("message.usage").alias("usage"), F.col("message.content").alias("blocks"),
    )
    rows = ranked(merged(shaped)).withColumn("text", T.visible_text("blocks"))
    codex = normalize.as_records(normalize.normalized(lines.where("agent = 'codex'").select("session_id", "line_no", "raw")))
    return rows.select(*_CANONICAL).unionByName(codex.select(*_CANONICAL))


def merged(rows: DataFrame) -> DataFrame:
    """Rows in which the rows of one assistant message of cowork are one: the first with the blocks of the later ones that it lacks, the last usage, the first model."""
    split = rows.where("agent = 'cowork' and type = 'assistant' and coalesce(message_id, '') <> ''")
    whole = rows.where("not coalesce(agent = 'cowork' and type = 'assistant' and coalesce(message_id, '') <> '', false)")
    key = ["session_id", "message_id"]
    parts = split.groupBy(*key).agg(
        F.min("record_index").alias("record_index"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("record_index"))).alias("__usage"),
        F.min_by("model", F.when(F.coalesce("model", F.lit("")) != "", F.col("record_index"))).alias("__model"), F.array_sort(F.collect_list(F.struct("record_index", "blocks"))).alias("__parts"),
    )
    none = F.expr("cast(array() as " + _CONTENT + ")")
    blocks = F.aggregate("__parts", none, lambda a, p: F.concat(a, F.filter(F.coalesce(p["blocks"], none), lambda b: ~F.array_contains(a, b))))
    first = split.join(parts, [*key, "record_index"]).withColumns({"usage": F.col("__usage"), "model": F.col("__model"), "blocks": blocks}).drop("__usage", "__model", "__parts")
    return whole.unionByName(first)


def side_times(lines: DataFrame, side: DataFrame) -> DataFrame:
    """side_metadata of cowork folders by session: (session_id, title, model, created_at, last_activity_at)."""
    files = lines.where("agent = 'cowork'").select("file").distinct().withColumn("folder", F.regexp_replace("file", "/audit\\.jsonl$", ""))
    return files.join(side, "folder").select(session_of(F.col("file")).alias("session_id"), "title", "model", "created_at", "last_activity_at")


def corpus_size(lines: DataFrame) -> DataFrame:
    """One row: files and bytes of a corpus."""
    return lines.select("file", "file_size").distinct().agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def fold_files(lines: DataFrame, **aggregates: Column) -> DataFrame:
    """One row per file: any aggregates over its lines, without collecting them; ``lines`` counts usable ones."""
    usable = F.try_parse_json("raw").isNotNull()
    return lines.where(usable).groupBy("file").agg(F.count("*").alias("lines"), *(c.alias(k) for k, c in aggregates.items()))


def mining_corpus(spark: SparkSession, root: str) -> DataFrame:
    """All transcripts below a folder but those of sub-agents."""
    return read_lines(spark, root).where(~F.col("file").contains("/subagents/"))


def new_files(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files to read again: those whose (agent, file, size, time) isn't in the saved index."""
    return files.join(index, ["agent", "file", "file_size", "modified_at"], "left_anti")


def merge_index(index: DataFrame, read: DataFrame) -> DataFrame:
    """The index after files were read: entries of the same files with another size or time are gone."""
    return index.join(read.select("agent", "file").distinct(), ["agent", "file"], "left_anti").unionByName(read)


def side_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The JSON file beside each cowork folder: (folder, title, model, created_at, last_activity_at); bad JSON gives nulls."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "local_*.json").text(root)
    meta = F.from_json("value", "sessionId string, cliSessionId string, title string, model string, createdAt bigint, lastActivityAt bigint")
    return raw.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.json$", "").alias("folder"), meta.alias("m")).select(
        "folder", "m.title", "m.model", F.timestamp_millis("m.createdAt").alias("created_at"), F.timestamp_millis("m.lastActivityAt").alias("last_activity_at")
    )


def content_blocks(content: Column) -> Column:
    """Message content as blocks: a plain string is one text block, null stays null.

    Parts of blocks that are objects or arrays are kept as JSON text.
    """
    as_text = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), _CONTENT[6:-1]))
    return F.when(content.rlike(r"^\s*\["), F.from_json(content, _CONTENT)).when(content.isNotNull(), as_text)


def message_records(lines: DataFrame) -> DataFrame:
    """Lines of the claude and cowork dialects as transcript records; lines that are no JSON object are dropped."""
    r = lines.where(F.col("raw").rlike(r"^\s*\{")).withColumn("r", F.from_json("raw", _RECORD)).where("r.type is not null")
    return r.select(
        *(c for c in lines.columns if c != "raw"), F.col("r.type").alias("rec_type"), "r.uuid", F.col("r.sessionId").alias("session_id"),
        F.coalesce("r.timestamp", "r._audit_timestamp").alias("ts_raw"), F.expr("try_to_timestamp(coalesce(r.timestamp, r._audit_timestamp))").alias("ts"), "r.cwd",
        F.col("r.isMeta").alias("is_meta"), F.col("r.isReplay").alias("is_replay"), F.col("r.isApiErrorMessage").alias("is_api_error"), "r.subtype", F.col("r.content").alias("content"),
        F.when(F.col("r.message").isNotNull(), F.struct("r.message.role", "r.message.model", "r.message.id", content_blocks(F.col("r.message.content")).alias("content"), "r.message.usage")).alias("message"),
    )
