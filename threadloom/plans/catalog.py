"""The registry of core queries: name -> callable(spark, sf_dir), and SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import cohort, detectors, drift, evidence, judges, normalize, phrases, redaction, speech, stats
from threadloom.operators.ordered import canonical, ranked, running
from threadloom.plans.oracle import SQL  # noqa: F401
from threadloom.session import materialize, read_table
from threadloom.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return canonical(read_table(spark, d, "records"))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    """The same rows without their order, for what only sums up."""
    return canonical(read_table(spark, d, "records"), in_order=False)


def _codex_lines(spark: SparkSession, d: str) -> DataFrame:
    files = read_table(spark, d, "raw_files").where("agent = 'codex'").select("file_id")
    return read_table(spark, d, "raw_lines").join(files, "file_id", "left_semi").select(F.col("file_id").cast("string").alias("session_id"), "line_no", "raw")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """The events table as ordered rows per user."""
    e = read_table(spark, d, "events")
    return ranked(e.select(F.col("user_id").cast("string").alias("session_id"), F.lit(None).cast("long").alias("record_index"), F.col("event_id").alias("rec_id"), "ts", "event_type", "value"))


# ---- problem 1 ---------------------------------------------------------------


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(read_table(spark, d, "raw_files"), read_table(spark, d, "raw_lines"))


@query
def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(read_table(spark, d, "raw_files"), read_table(spark, d, "raw_lines"))


# ---- statistics --------------------------------------------------------------


@query
def turn_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.turn_stats(_rows(spark, d))


@query
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.report_totals(_plain(spark, d), read_table(spark, d, "sessions"))


@query
def word_averages(spark: SparkSession, d: str) -> DataFrame:
    return stats.word_averages(_rows(spark, d))


@query
def active_days_duration(spark: SparkSession, d: str) -> DataFrame:
    return stats.active_days(_plain(spark, d))


@query
def session_turn_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.session_turn_counts(_plain(spark, d))


@query
def top_tools(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_tools(_plain(spark, d))


@query
def tool_action_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.tool_action_counts(_plain(spark, d))


@query
def usage_share(spark: SparkSession, d: str) -> DataFrame:
    return stats.usage_share(_plain(spark, d))


@query
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.usage_totals(_plain(spark, d))


@query
def weighted_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost with example rates; the table of rates is the caller's."""
    rates = spark.createDataFrame([("opus", 1, 4.0, 8.0, 2.0, 1.0), ("gpt", 2, 2.0, 4.0, 1.0, 0.5), ("", 9, 1.0, 2.0, 0.5, 0.25)], "pattern string, priority int, input double, output double, cache_write double, cache_read double")
    return stats.weighted_cost(_plain(spark, d), rates)


@query
def agent_share(spark: SparkSession, d: str) -> DataFrame:
    return stats.agent_share(read_table(spark, d, "sessions"))


@query
def tone_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.tone_counts(_plain(spark, d))


@query
def stock_phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.stock_phrases(_plain(spark, d))


@query
def project_rollup(spark: SparkSession, d: str) -> DataFrame:
    return stats.project_rollup(read_table(spark, d, "sessions"), read_table(spark, d, "projects"))


@query
def session_tokens(spark: SparkSession, d: str) -> DataFrame:
    return stats.session_tokens(_plain(spark, d))


@query
def model_totals_top50(spark: SparkSession, d: str) -> DataFrame:
    return stats.model_totals(_plain(spark, d))


@query
def session_metadata(spark: SparkSession, d: str) -> DataFrame:
    return stats.file_metadata(_rows(spark, d))


@query
def default_window(spark: SparkSession, d: str) -> DataFrame:
    return stats.default_window(read_table(spark, d, "sessions")).select("session_id", "project_id")


@query
def model_names(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "records").select(F.col("message.model").alias("model")).where("model is not null").distinct()
    return m.select("model", T.model_name(F.col("model")).alias("name"))


@query
def project_names(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "projects").select("project_id", T.project_name(F.col("cwd")).alias("name"), T.opaque_id(F.col("cwd")).alias("opaque_id"))


# ---- language, topics, tone --------------------------------------------------


@query
def language_share(spark: SparkSession, d: str) -> DataFrame:
    return speech.language_share(_plain(spark, d))


@query
def language_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return speech.language_anomaly(_rows(spark, d))


@query
def topic_share(spark: SparkSession, d: str) -> DataFrame:
    return speech.topic_share(_rows(spark, d))


@query
def topic_inherit(spark: SparkSession, d: str) -> DataFrame:
    return speech.prompt_topics(_rows(spark, d))


@query
def topic_topk_openings(spark: SparkSession, d: str) -> DataFrame:
    return speech.topic_openings(_rows(spark, d))


@query
def topic_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Sessions and tokens by what a judge of topics gets: its candidates, overflow, sessions without an opening."""
    return speech.topic_bundle(_rows(spark, d)).groupBy("standing").agg(F.count("*").alias("sessions"), F.sum("tokens").alias("tokens"))


@query
def topic_weighted_share(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    return speech.topic_weights(r, speech.keyword_verdicts(r))


@query
def tone_candidates(spark: SparkSession, d: str) -> DataFrame:
    return speech.tone_candidates(_plain(spark, d))


@query
def tone_batches(spark: SparkSession, d: str) -> DataFrame:
    return speech.tone_batches(speech.tone_candidates(_plain(spark, d)))


@query
def judge_weighted_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = speech.tone_candidates(_plain(spark, d))
    return speech.tone_result(c, speech.keyword_tones(c))


@query
def frustration_quotes(spark: SparkSession, d: str) -> DataFrame:
    return speech.frustration_quotes(_plain(spark, d))


@query
def share_safe_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", T.share_safe(F.col("text"), 2, 600, 40).alias("share_safe"))


# ---- behaviour ---------------------------------------------------------------


@query
def detect_findings(spark: SparkSession, d: str) -> DataFrame:
    return detectors.detect(_rows(spark, d)).select("session_id", "i", "kind", "score")


@query
def finding_top3_per_kind(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    return detectors.top_findings(detectors.detect(r), r).select("kind", "place", "session_id", "i", "confidence")


@query
def finding_excerpts(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    return detectors.excerpts(detectors.detect(r), r)


@query
def trajectory_events(spark: SparkSession, d: str) -> DataFrame:
    return detectors.trajectory(_rows(spark, d)).select("session_id", "ordinal", "role", "kind", "action", "method", "model")


@query
def blocker_windows(spark: SparkSession, d: str) -> DataFrame:
    return detectors.blocker_windows(_blocked(spark, d))


def _blocked(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories of transcripts whose failed tools say what blocked them; the test tables' failures name no reason, so one is written into them."""
    said = F.transform("blocks", lambda b: b.withField("content", F.when((b["type"] == "tool_result") & F.coalesce(b["is_error"], F.lit(False)), "permission denied").otherwise(b["content"])))
    return detectors.trajectory(_rows(spark, d).withColumn("blocks", said))


@query
def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return detectors.window_chunks(detectors.blocker_windows(_blocked(spark, d)))


@query
def chunk_events(spark: SparkSession, d: str) -> DataFrame:
    e = materialize(_blocked(spark, d), "events")
    return detectors.chunk_events(detectors.window_chunks(detectors.blocker_windows(e)), e).select("session_id", "part_index", "ordinal", "kind")


@query
def batch_greedy(spark: SparkSession, d: str) -> DataFrame:
    e = materialize(_blocked(spark, d), "events")
    return detectors.batches(detectors.window_chunks(detectors.blocker_windows(e)), e)


@query
def chunk_checks(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks may go to a judge."""
    e = materialize(_blocked(spark, d), "events")
    c = detectors.window_chunks(detectors.blocker_windows(e))
    return detectors.valid_chunks(c, e).groupBy("valid").agg(F.count("*").alias("chunks"))


@query
def trajectory_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = materialize(_blocked(spark, d), "events")
    return detectors.trajectory_coverage(e, detectors.window_chunks(detectors.blocker_windows(e)))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    e = materialize(_blocked(spark, d), "events")
    return evidence.resolve(evidence.nearest_verdicts(e), e)


@query
def workaround_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select("session_id", "blocker", "original", "alternative", "standing", "disclosure", "summary", "model")


@query
def workaround_card(spark: SparkSession, d: str) -> DataFrame:
    c = evidence.workaround_card(materialize(_verdicts(spark, d), "verdicts"))
    return c.select("count", "example", F.to_json("models").alias("models"))


@query
def tone_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests to a judge of tone: how many candidates each holds, and the ids it may answer."""
    c = materialize(speech.tone_candidates(_plain(spark, d)), "tone")
    local = c.join(speech.tone_batches(c), "rank").select(F.concat(F.lit("interaction-"), F.format_string("%02d", "batch_rank")).alias("candidate_id"), "text", "occurrences", "batch")
    r = judges.requests(local, "tone", "Say of each message whether it is frustrated and whether it is grateful.", batch=F.col("batch"))
    return r.select("batch", "n", F.get_json_object("request", "$.answer.verdicts").cast("int").alias("verdicts"), F.get_json_object("request", "$.answer.ids").alias("ids"))


@query
def funniest_quote(spark: SparkSession, d: str) -> DataFrame:
    c = materialize(speech.tone_candidates(_plain(spark, d)), "tone")
    return speech.funniest(c, speech.keyword_tones(c))


@query
def judge_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = speech.tone_candidates(_plain(spark, d))
    return evidence.coverage(c, speech.keyword_tones(c), "rank")


@query
def evidence_preview(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    return evidence.preview(r, detectors.detect(r).where("kind = 'repetition'"))


@query
def evidence_texts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", evidence.evidence_text(F.col("text")).alias("excerpt"))


@query
def text_parts(spark: SparkSession, d: str) -> DataFrame:
    return evidence.text_parts(read_table(spark, d, "documents"), "doc_id", "text")


@query
def mask_names(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", evidence.mask_names(F.col("text")).alias("masked"))


@query
def number_formats(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("n"))
    return o.select("o_orderkey", evidence.compact_number(F.col("n")).alias("compact"), evidence.duration_text(F.col("n")).alias("duration"), evidence.ordinal_text(F.col("n")).alias("ordinal"))


@query
def public_report(spark: SparkSession, d: str) -> DataFrame:
    """Model shares as they may be published: bounded, displayable ones, largest first."""
    u = stats.usage_share(_plain(spark, d))
    out = u.select(evidence.bounded_text(F.col("model"), 80).alias("model"), evidence.bounded_number(F.col("percent"), 100).alias("percent"))
    return evidence.guard(out.where(evidence.displayable(F.col("percent"))), "model")


# ---- phrases -----------------------------------------------------------------


@query
def ngram_miner(spark: SparkSession, d: str) -> DataFrame:
    return phrases.ngram_miner(_plain(spark, d))


@query
def phrase_candidates(spark: SparkSession, d: str) -> DataFrame:
    return phrases.phrase_candidates(_plain(spark, d))


@query
def phrase_suppressed(spark: SparkSession, d: str) -> DataFrame:
    return phrases.suppressed(phrases.phrase_candidates(_plain(spark, d)))


@query
def phrase_card(spark: SparkSession, d: str) -> DataFrame:
    """The favourite phrase: the best ranked candidate."""
    return phrases.phrase_candidates(_plain(spark, d)).orderBy(F.desc("sessions"), F.desc("occurrences"), F.desc("n"), "phrase").limit(1)


@query
def ngram_suppressed(spark: SparkSession, d: str) -> DataFrame:
    """The commonest n-grams without nested ones about as frequent."""
    return phrases.suppressed(phrases.ngram_rows(_plain(spark, d)), 50, order=("occurrences", "sessions", "n"))


@query
def phrase_variants(spark: SparkSession, d: str) -> DataFrame:
    return phrases.variants(_rows(spark, d)).select("variant_id", "occurrences", "sessions", "openings")


@query
def neardup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return phrases.similar_pairs(phrases.variants(_rows(spark, d)))


@query
def neardup_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """Near duplicates by every shared shingle, however common."""
    return phrases.similar_pairs(phrases.sequences(_plain(spark, d)), None, None)


@query
def family_components(spark: SparkSession, d: str) -> DataFrame:
    v = phrases.variants(_rows(spark, d))
    return phrases.components(v, phrases.similar_pairs(v))


@query
def neardup_families(spark: SparkSession, d: str) -> DataFrame:
    counted = phrases.by_session(phrases.family_units(_rows(spark, d)))
    v = materialize(phrases.variants_of(counted), "variants")
    return phrases.families(counted, phrases.similar_pairs(v))


@query
def family_counters(spark: SparkSession, d: str) -> DataFrame:
    return phrases.mining_counters(_rows(spark, d))


# ---- redaction and donation --------------------------------------------------


@query
def redact_patterns(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", redaction.redact_full(F.col("text")).alias("redacted"))


@query
def redact_presets(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", redaction.custom_rules(F.col("text"), list(redaction.PRESETS.values())).alias("redacted"))


@query
def redaction_inventory(spark: SparkSession, d: str) -> DataFrame:
    return redaction.inventory(redaction.redact_rows(_plain(spark, d).select("rec_id", "text"), "rec_id", "text", heuristic=False), "rec_id")


@query
def donation_preview(spark: SparkSession, d: str) -> DataFrame:
    return cohort.donation_preview(_rows(spark, d))


@query
def donation_inventory(spark: SparkSession, d: str) -> DataFrame:
    return cohort.donation_inventory(_rows(spark, d))


# ---- cohort and charts -------------------------------------------------------


@query
def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    return cohort.percentile_ranks(read_table(spark, d, "customer"), "c_custkey", "c_acctbal")


@query
def good_human_score(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("good"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return e.select("user_id", cohort.share_score(F.col("good"), F.col("bad")).alias("score"))


@query
def session_lengths_unnest(spark: SparkSession, d: str) -> DataFrame:
    """The stored prompts per session of every participant, projects standing for participants."""
    turns = _plain(spark, d).where(stats.PROMPT).groupBy("session_id").agg(F.count("*").alias("turns"))
    owned = turns.join(read_table(spark, d, "sessions").select("session_id", F.coalesce("project_id", F.lit("none")).alias("participant")), "session_id")
    return cohort.stored_lengths(owned, "participant").select("participant", F.posexplode(cohort.session_lengths(F.col("stored"))).alias("place", "turns"))


@query
def turn_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.turn_counts(_plain(spark, d))


@query
def cohort_latest_upsert(spark: SparkSession, d: str) -> DataFrame:
    return cohort.latest(read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", "o_orderdate", "o_orderkey")


@query
def opt_out_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers but those who opted out, for whom those with an open order stand."""
    gone = read_table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return cohort.without(read_table(spark, d, "customer"), gone, "c_custkey").select("c_custkey", "c_mktsegment")


@query
def phrase_wall_last_n(spark: SparkSession, d: str) -> DataFrame:
    """The newest phrases fit for a card, out of the documents' lines of plain words."""
    docs = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), r"[^a-z' ]+")).alias("line", "phrase"))
    p = docs.select((F.col("doc_id") * 1_000_000 + F.col("line")).alias("spot"), F.trim("phrase").alias("phrase"))
    return cohort.card_phrases(p, "phrase", "spot")


@query
def public_slides(spark: SparkSession, d: str) -> DataFrame:
    """The topics a slide shows."""
    return cohort.slides(speech.topic_share(_rows(spark, d)), "topic", 5).select("rank", "topic", "percent")


@query
def demo_cohort(spark: SparkSession, d: str) -> DataFrame:
    return cohort.demo_cohort(spark).select("participant_id", "tokens", "word_ratio", "good_human_score", "instrumental_workarounds", F.size("session_turn_counts").alias("sessions"))


@query
def relationship_points(spark: SparkSession, d: str) -> DataFrame:
    """Ratio and score of every user with either kind of event, users standing for participants."""
    e = read_table(spark, d, "events").groupBy(F.col("user_id").alias("participant_id")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("grateful_messages"), F.count_if(F.col("event_type") == "error").alias("frustrated_messages"), F.round(F.avg("value"), 2).alias("word_ratio")
    )
    return cohort.relationship(e)


@query
def leaderboard_aggregate(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    return cohort.aggregate_row(stats.report_totals(_plain(spark, d), read_table(spark, d, "sessions")), stats.tone_counts(r), stats.word_averages(r), phrases.phrase_candidates(r)).where(cohort.valid_aggregate())


@query
def median_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return cohort.quantiles(read_table(spark, d, "events"), "event_type", "value")


@query
def kde_grid(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").where("value > 0").select(F.log10("value").alias("v"))
    return cohort.density(e, "v")


# ---- normalisers -------------------------------------------------------------


@query
def codex_records(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalized(_codex_lines(spark, d))


@query
def forward_fill_model(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d).select("session_id", "i", "model")
    return running(r.withColumnRenamed("model", "declared"), lasts={"model": F.when(F.col("declared") != "<synthetic>", F.col("declared"))}).select("session_id", "i", "model")


@query
def delta_from_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Running totals of each user's values, and the differences that give the values back."""
    s = running(_steps(spark, d).select("session_id", "i", F.round("value").cast("long").alias("value")), sums={"total": F.col("value")})
    prior = s.select("session_id", (F.col("i") + 1).alias("i"), F.col("total").alias("prior"))
    return s.join(prior, ["session_id", "i"], "left").select("session_id", "i", "total", F.greatest(F.lit(0), F.col("total") - F.coalesce("prior", F.lit(0))).alias("delta"))


@query
def call_result_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Tool results with the latest use of their id in the session."""
    r = _rows(spark, d).select("session_id", "i", F.posexplode("blocks").alias("k", "b")).where("b.type in ('tool_use', 'tool_result')")
    e = r.select("session_id", "i", "k", F.coalesce("b.id", "b.tool_use_id").alias("ref"), F.when(F.col("b.type") == "tool_use", F.struct("i", "b.name")).alias("use"), (F.col("b.type") == "tool_result").alias("is_result")).where("ref is not null")
    from pyspark.sql import Window

    w = Window.partitionBy("session_id", "ref").orderBy("i", "k").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("call", F.last("use", True).over(w)).where("is_result").select("session_id", "i", "k", "ref", F.col("call.i").alias("call_i"), F.col("call.name").alias("tool"))


@query
def replay_dedup(spark: SparkSession, d: str) -> DataFrame:
    return normalize.replay_dedup(read_table(spark, d, "records").where("session_id is not null").withColumn("session_id", F.lower(F.regexp_replace("session_id", r"(?U)^\s+|\s+$", "")))).select("rec_id", "session_id", "rec_type")


@query
def split_merge(spark: SparkSession, d: str) -> DataFrame:
    return normalize.merge_split_messages(_rows(spark, d)).select("session_id", "i", "n_rows", "model", F.size("blocks_json").alias("n_blocks"))


@query
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """The first two fields of the events' JSON, by value."""
    e = read_table(spark, d, "events").select(F.posexplode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("pos", "kv"))
    return e.groupBy(F.col("kv.key").alias("key")).agg(F.count("*").alias("n"), F.count_distinct("kv.value").alias("n_values"))


@query
def prose_words(spark: SparkSession, d: str) -> DataFrame:
    """Words and sentences of each document's prose."""
    p = T.tone_prose(F.col("text"))
    return read_table(spark, d, "documents").select("doc_id", T.word_count(p).alias("words"), F.size(T.sentences(p)).alias("sentences"))


@query
def session_gap(spark: SparkSession, d: str) -> DataFrame:
    return streams.session_gaps(read_table(spark, d, "events"), "user_id", "ts", "6 hours")


@query
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed_counts(read_table(spark, d, "events"), "ts", "event_type", "1 day").withColumn("total", F.round("total", 2))
