"""Core statistics of sessions: turns, words, tokens, tools, models, tone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import patterns as P
from threadloom.functions import text as T
from threadloom.operators.ordered import cumulative, running

PROMPT = "type = 'user' and not is_meta and text <> ''"
TOKENS = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]


def token_sum(prefix: str = "usage") -> Column:
    out = F.lit(0)
    for t in TOKENS:
        out = out + F.coalesce(F.col(f"{prefix}.{t}"), F.lit(0))
    return out


def report_totals(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: sessions, active days, prompts, tool calls, interruptions, tokens, minutes."""
    prompt = F.expr(PROMPT)
    stops = (F.col("type") == "system") & F.concat_ws(" ", F.coalesce("subtype", F.lit("")), F.coalesce("sys_content", F.lit(""))).rlike("(?i)interrupt")
    base = rows.agg(
        F.count_distinct(F.to_date("ts")).alias("active_days"), F.count_if(prompt).alias("prompts"), F.count_if(stops).alias("interruptions"),
        F.coalesce(F.sum(F.coalesce(F.size(F.filter("blocks", lambda b: b["type"] == "tool_use")), F.lit(0))), F.lit(0)).cast("long").alias("tool_calls"),
        F.coalesce(F.sum(token_sum()), F.lit(0)).alias("tokens"),
    )
    return base.crossJoin(sessions.agg(F.count("*").alias("sessions"))).crossJoin(duration(rows))


def duration(rows: DataFrame) -> DataFrame:
    """One row: minutes between first and last record, summed over sessions."""
    each = rows.where("ts is not null").groupBy("session_id").agg((F.max(F.unix_millis("ts")) - F.min(F.unix_millis("ts"))).alias("ms"))
    return each.agg(F.floor(F.coalesce(F.sum("ms"), F.lit(0)) / 60000.0 + 0.5).alias("duration_minutes"))


def active_days(rows: DataFrame) -> DataFrame:
    """Per session: days with records and milliseconds from first to last."""
    return rows.where("ts is not null").groupBy("session_id").agg(
        F.count_distinct(F.to_date("ts")).alias("active_days"), (F.max(F.unix_millis("ts")) - F.min(F.unix_millis("ts"))).alias("duration_ms")
    )


def turns(rows: DataFrame) -> DataFrame:
    """Rows with ``turn``, the number of prompts up to and with the row."""
    return running(rows, sums={"turn": F.expr(f"cast({PROMPT} as long)")})


def turn_stats(rows: DataFrame) -> DataFrame:
    """Per session: turns, user words, agent words and answered turns."""
    words = turns(rows.select("session_id", "i", "type", "is_meta", "text")).withColumn("words", T.word_count(F.col("text")))
    each = words.groupBy("session_id", "turn").agg(
        F.sum(F.expr(f"if({PROMPT}, words, 0)")).alias("user_words"),
        F.sum(F.expr("if(type = 'assistant' and turn > 0, words, 0)")).alias("agent_words"),
    )
    return each.groupBy("session_id").agg(
        F.max("turn").alias("turns"), F.sum("user_words").alias("user_words"), F.sum("agent_words").alias("agent_words"),
        F.count_if(F.col("agent_words") > 0).alias("responses"),
    )


def word_averages(rows: DataFrame) -> DataFrame:
    """One row: total and mean words of users and agents, and their ratio."""
    s = turn_stats(rows).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("turns", "user_words", "agent_words", "responses")))
    mean = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) / F.col(b) + 0.5)).otherwise(0).cast("long")
    return s.select(
        "user_words", "agent_words", mean("user_words", "turns").alias("average_user_words"), mean("agent_words", "responses").alias("average_response_words"),
        F.when(F.col("user_words") > 0, F.floor(F.col("agent_words") * 100 / F.col("user_words") + 0.5) / 100).alias("agent_user_ratio"),
    )


def session_turn_counts(rows: DataFrame) -> DataFrame:
    """How many sessions have how many prompts, sessions without any left out."""
    return rows.where(PROMPT).groupBy("session_id").agg(F.count("*").alias("turns")).groupBy("turns").agg(F.count("*").alias("n_sessions"))


def turn_counts(rows: DataFrame) -> DataFrame:
    """(place, turns): the prompts of each session with any, ascending, numbered from 1, with the longest in ``longest``."""
    each = rows.where(PROMPT).groupBy("session_id").agg(F.count("*").alias("turns"))
    n = each.groupBy("turns").agg(F.count("*").alias("n"))
    upto = cumulative(n, [], "turns")
    out = upto.select("turns", F.explode(F.expr("sequence(upto - n + 1, upto)")).alias("place"))
    return out.crossJoin(n.agg(F.coalesce(F.max("turns"), F.lit(0)).alias("longest")))


def judge_usage(usages: DataFrame) -> DataFrame:
    """One row: what judges used, summed; null where no answer told."""
    cols = ("prompt_tokens", "completion_tokens", "total_tokens", "cost")
    told = F.count_if(F.greatest(*(F.col(c).isNotNull().cast("int") for c in cols)) == 1) > 0
    return usages.agg(*(F.when(told, F.coalesce(F.sum(c), F.lit(0))).alias(c) for c in cols))


def tool_calls(rows: DataFrame) -> DataFrame:
    """One row per tool use: session, record, block, name and arguments."""
    return rows.select("session_id", "rec_id", F.posexplode("blocks").alias("block_no", "b")).where("b.type = 'tool_use'").select(
        "session_id", "rec_id", "block_no", F.coalesce("b.name", F.lit("Unknown tool")).alias("tool"), F.col("b.input").alias("arguments"), F.col("b.id").alias("call_id")
    )


def top_tools(rows: DataFrame, most: int = 6) -> DataFrame:
    """The tools used most, ties by first appearance."""
    return tool_calls(rows).groupBy("tool").agg(F.count("*").alias("n"), F.min(F.struct("rec_id", "block_no")).alias("first")).orderBy(
        F.desc("n"), "first"
    ).limit(most).select("tool", "n")


def tool_action_counts(rows: DataFrame) -> DataFrame:
    """Tool uses by what they do and how."""
    return tool_calls(rows).withColumn("s", T.tool_semantics(F.col("tool"), F.col("arguments"))).groupBy(
        F.coalesce("s.action", F.lit("none")).alias("action"), F.col("s.method").alias("method")
    ).agg(F.count("*").alias("n"))


def usage_share(rows: DataFrame) -> DataFrame:
    """Tokens by model and their share of all."""
    used = rows.where("usage is not null").withColumn(
        "m", F.coalesce("model", F.when(F.col("agent") == "codex", "Codex model").otherwise("Claude model"))
    ).groupBy("m").agg(F.sum(token_sum()).alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy())
    return used.select(T.model_name(F.col("m")).alias("model"), "tokens", F.when(total > 0, F.floor(F.col("tokens") * 1000 / total + 0.5) / 10).otherwise(0.0).alias("percent"))


def weighted_cost(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost by model from a small table of rates: rates(pattern, priority, input, output, cache_write, cache_read) per million tokens.

    The pattern with the least priority that a model contains counts.
    """
    used = rows.where("usage is not null").groupBy(F.coalesce("model", F.lit("")).alias("model")).agg(
        *(F.sum(F.coalesce(f"usage.{t}", F.lit(0))).alias(t) for t in TOKENS)
    )
    fit = used.join(rates, F.lower("model").contains(F.col("pattern")))
    best = fit.groupBy("model").agg(F.min_by(F.struct(*TOKENS, "input", "output", "cache_write", "cache_read"), "priority").alias("x"))
    cost = sum((F.col(f"x.{t}") * F.col(f"x.{r}") for t, r in zip(TOKENS, ("input", "output", "cache_write", "cache_read"))), F.lit(0.0))
    return best.select("model", F.round(cost / 1e6, 4).alias("cost"))


def total_cost(by_model: DataFrame) -> DataFrame:
    """One row: the cost of all models, to the cent."""
    return by_model.agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("cost"))


def agent_share(sessions: DataFrame) -> DataFrame:
    """Sessions by agent, all agents present, with their share."""
    spark = sessions.sparkSession
    all_agents = spark.createDataFrame(P.AGENTS, "agent string, name string")
    n = sessions.groupBy("agent").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return all_agents.join(n, "agent", "left").select("agent", "name", F.coalesce("n", F.lit(0)).alias("n")).select(
        "agent", "name", "n", F.when(total > 0, F.floor(F.col("n") * 1000 / total + 0.5) / 10).otherwise(0.0).alias("percent")
    )


def tone_counts(rows: DataFrame) -> DataFrame:
    """One row: prompts looked at, frustrated and grateful ones."""
    p = rows.where(PROMPT)
    return p.agg(F.count("*").alias("analyzed"), F.count_if(T.is_frustrated(F.col("text"))).alias("frustrated"), F.count_if(T.is_grateful(F.col("text"))).alias("grateful"))


def stock_phrases(rows: DataFrame) -> DataFrame:
    """How often agents use each stock phrase, zero included."""
    prose = T.analysis_prose(F.col("text"))
    sums = rows.where("type = 'assistant'").select(prose.alias("prose")).agg(
        *(F.coalesce(F.sum(T.occurrences(F.col("prose"), p)), F.lit(0)).alias(f"n{k}") for k, (_, p) in enumerate(P.STOCK_PHRASES))
    )
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(name).alias("phrase"), F.col(f"n{k}").alias("n")) for k, (name, _) in enumerate(P.STOCK_PHRASES)))))


def project_rollup(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project: sessions, latest start and the agents used."""
    s = sessions.groupBy("project_id").agg(F.count("*").alias("session_count"), F.max("started_at").alias("latest_at"), F.array_join(F.sort_array(F.collect_set("agent")), ",").alias("agents"))
    return s.join(projects.select("project_id", "project_name"), "project_id", "left")


def session_tokens(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.sum(token_sum()).alias("tokens"))


def usage_totals(rows: DataFrame) -> DataFrame:
    """Each token component by agent; null where no record has it."""
    return rows.groupBy("agent").agg(*(F.sum(f"usage.{t}").alias(t) for t in TOKENS))


def model_totals(rows: DataFrame, most: int = 50) -> DataFrame:
    """Tool errors by model in use, most first."""
    return rows.where("type = 'assistant' and model is not null").groupBy("model").agg(
        F.sum(F.coalesce(F.size(F.filter("blocks", lambda b: b["type"] == "tool_use")), F.lit(0))).cast("long").alias("total")
    ).orderBy(F.desc("total"), "model").limit(most)


def file_metadata(rows: DataFrame) -> DataFrame:
    """Per session: first and last time in file order, prompts and records (the catalogue counts prompts without text)."""
    return rows.groupBy("session_id").agg(
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("i"))).alias("cwd"), F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("i"))).alias("started_at"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("i"))).alias("ended_at"),
        F.count_if((F.col("type") == "user") & ~F.col("is_meta")).alias("prompt_count"), F.count("*").alias("record_count"),
    )


def catalogue(rows: DataFrame, files: DataFrame, side: DataFrame | None = None) -> DataFrame:
    """One row per session of files(session_id, file, agent, size_bytes, modified_at): the catalogue of what can be analysed.

    Times a file lacks are those of its last change; of sessions with a side file
    side(session_id, created_at, last_activity_at) its times come first.
    """
    m = files.join(file_metadata(rows), "session_id", "left")
    started, ended = F.col("started_at"), F.col("ended_at")
    if side is not None:
        m = m.join(side.select("session_id", "created_at", "last_activity_at"), "session_id", "left")
        started, ended = F.coalesce("created_at", "started_at"), F.coalesce("last_activity_at", "ended_at")
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    own = F.col("agent") == "cowork"
    key = F.when(own, F.concat(F.lit("cowork:"), F.regexp_extract(folder, "^(.*)/[^/]*$", 1))).otherwise(F.coalesce("cwd", F.concat_ws(":", "agent", folder)))
    name = F.when(own, "Cowork").otherwise(T.project_name(F.coalesce("cwd", F.regexp_replace(folder, "^.*[/-]", ""))))
    return m.select(
        "session_id", "file", "agent", T.agent_name(F.col("agent")).alias("agent_name"), T.opaque_id(key).alias("project_id"), name.alias("project_name"),
        F.coalesce(started, "modified_at").alias("started_at"), F.coalesce(ended, "modified_at").alias("ended_at"), F.coalesce("prompt_count", F.lit(0)).alias("prompt_count"),
        F.coalesce("record_count", F.lit(0)).alias("record_count"), "size_bytes", F.lit(False).alias("synthetic"),
    )


def selected(sessions: DataFrame, projects: list[str] | None = None, first=None, last=None) -> DataFrame:
    """Sessions of some projects and days, as far as either is asked for."""
    out = sessions if projects is None else sessions.where(F.col("project_id").isin(projects))
    day = F.to_date("started_at")
    out = out if first is None else out.where(day >= F.lit(first).cast("date"))
    return out if last is None else out.where(day <= F.lit(last).cast("date"))


def default_window(sessions: DataFrame, days: int = 30) -> DataFrame:
    """Sessions that started within ``days`` days up to the latest start, both ends included."""
    end = sessions.agg(F.max(F.to_date("started_at")).alias("last_day"))
    return sessions.crossJoin(end).where(F.to_date("started_at").between(F.date_sub("last_day", days - 1), F.col("last_day"))).drop("last_day")
