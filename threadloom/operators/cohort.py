"""Cohort analytics over one row per participant, donation previews, and the statistics behind charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import patterns as P
from threadloom.functions import text as T
from threadloom.operators.ordered import cumulative
from threadloom.operators.redaction import inventory, redact_full, redact_rows
from threadloom.session import materialize


def percentile_ranks(df: DataFrame, key: str, value: str) -> DataFrame:
    """Every row's percentile: the rounded share of values not above it; nulls have none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    upto = cumulative(counts, [], value)
    total = df.agg(F.count(value).alias("all"))
    placed = upto.crossJoin(total).select(value, F.floor(F.col("upto") * 100 / F.col("all") + 0.5).cast("int").alias("percentile"))
    return df.select(key, value).join(placed, value, "left").select(key, value, "percentile")


def share_score(good: Column, bad: Column) -> Column:
    """100 x good / (good + bad) with one decimal, null for none."""
    return F.when(good + bad > 0, F.floor(good * 1000 / (good + bad) + 0.5) / 10)


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """An upsert on plain files: the newest row of each key."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(at, tie)).alias("x")).select(key, "x.*")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key opted out are left out."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def last_reversed(df: DataFrame, by: str, n: int = 200) -> DataFrame:
    """The last n rows, newest first."""
    return df.orderBy(F.desc(by)).limit(n)


def card_phrases(df: DataFrame, phrase: str, by: str, n: int = 200) -> DataFrame:
    """The last n phrases fit for a card, newest first."""
    return last_reversed(df.where(F.col(phrase).rlike(P.CARD_PHRASE)), by, n)


def participation(entries: DataFrame, key: str, wanted: Column | str) -> DataFrame:
    """One row: whether a participant is there, its number, and whether it shares a phrase."""
    found = entries.where(F.col(key) == wanted).agg(F.count("*").alias("n"), F.max("participant_id").alias("participant_id"), F.max(F.col("favorite_phrase").isNotNull()).alias("shares_phrase"))
    return found.select((F.col("n") > 0).alias("joined"), "participant_id", "shares_phrase")


def relationship(entries: DataFrame) -> DataFrame:
    """Points (participant_id, ratio, score) of all participants with a score."""
    return entries.select("participant_id", F.col("word_ratio").alias("ratio"), share_score(F.col("grateful_messages"), F.col("frustrated_messages")).alias("score")).where("score is not null")


def demo_cohort(spark) -> DataFrame:
    """The twelve made-up participants of a demonstration."""
    rows = [(k + 1, t, r, s, w, c) for k, (t, r, s, w, c) in enumerate(zip(P.DEMO_TOKENS, P.DEMO_RATIOS, P.DEMO_SCORES, P.DEMO_WORKAROUNDS, P.DEMO_TURNS))]
    return spark.createDataFrame(rows, "participant_id int, tokens long, word_ratio double, good_human_score double, instrumental_workarounds long, session_turn_counts array<bigint>")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, keep: list[str] = (), at: str = "updated_at") -> DataFrame:
    """Stored rows with the incoming ones in their place; columns of ``keep`` stay as stored where the key was known.

    Of several incoming rows of a key the newest counts, ties by all its values.
    """
    cols = [c for c in stored.columns if c != key]
    new = incoming.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(at, *[c for c in cols if c != at])).alias("new"))
    both = stored.select(key, F.struct(*cols).alias("old")).join(new, key, "full")
    pick = lambda c: F.when(F.col("new").isNull() | (F.col("old").isNotNull() & F.lit(c in keep)), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
    return both.select(key, *(pick(c).alias(c) for c in cols))


def replace_children(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Child rows of the incoming keys in place of all their stored ones."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def opt_outs(stored: DataFrame, gone: DataFrame, included: DataFrame, key: str) -> DataFrame:
    """The keys opted out after new ones leave and others are included again."""
    return stored.select(key).union(gone.select(key)).distinct().join(included.select(key).distinct(), key, "left_anti")


def session_lengths(json: Column, most: int = 2000) -> Column:
    """The first lengths of a JSON array, then those outside 1 to 1e6 dropped."""
    return F.filter(F.slice(F.coalesce(F.from_json(json, "array<bigint>"), F.array().cast("array<bigint>")), 1, most), lambda x: x.between(1, 1_000_000))


def stored_lengths(turns: DataFrame, participant: str, most: int = 2000) -> DataFrame:
    """turns(participant, session_id, turns) -> (participant, stored): each participant's lengths as JSON, ascending, ``most`` at most as the store takes no more."""
    few = turns.withColumn("__r", F.row_number().over(Window.partitionBy(participant).orderBy("turns", "session_id"))).where(F.col("__r") <= most)
    return few.groupBy(participant).agg(F.to_json(F.sort_array(F.collect_list("turns"))).alias("stored"))


def quantiles(df: DataFrame, group: str, value: str, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles with linear interpolation, from counts by value: no task holds the values of a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = cumulative(counts, [group], "v")
    total = counts.groupBy(group).agg(F.sum("n").alias("all"))
    placed = upto.join(total, group).withColumn("first", F.col("upto") - F.col("n"))
    ranks = {q: (F.col("all") - 1) * F.lit(q) for q in at}
    at_rank = lambda r: F.max(F.when((F.col("first") <= r) & (r < F.col("upto")), F.col("v")))
    ends = placed.groupBy(group).agg(
        *(at_rank(F.floor(r)).alias(f"lo{k}") for k, r in enumerate(ranks.values())), *(at_rank(F.ceil(r)).alias(f"hi{k}") for k, r in enumerate(ranks.values())),
        F.first("all").alias("all"),
    )
    part = lambda q: (F.col("all") - 1) * F.lit(q) - F.floor((F.col("all") - 1) * F.lit(q))
    return ends.select(group, *((F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * part(q)).alias(f"q{int(q * 100)}") for k, q in enumerate(at)))


def density(df: DataFrame, value: str, points: int = 72) -> DataFrame:
    """A Gaussian kernel density on a grid, 1 at its peak: (point, x, density); every value counts as it is.

    Each distinct value meets the points of the grid inside its task and only sums
    by point are shuffled.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    v = materialize(v, "density")
    edge = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    grid = v.crossJoin(edge).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x).withColumn("h", F.greatest(F.lit(0.16), (F.col("hi") - F.col("lo")) / 13))
    d = grid.groupBy("point").agg(F.first("x").alias("x"), F.sum(F.col("n") * F.exp(-0.5 * F.pow((F.col("v") - F.col("x")) / F.col("h"), 2))).alias("d"))
    return d.select("point", F.round("x", 6).alias("x"), F.round(F.col("d") / F.max("d").over(Window.partitionBy()), 4).alias("density"))


def aggregate_row(totals: DataFrame, tones: DataFrame, words: DataFrame, phrases: DataFrame) -> DataFrame:
    """A report as one flat row for a cohort table, with fallbacks and bounds."""
    best = phrases.orderBy(F.desc("sessions"), F.desc("occurrences"), F.desc("n"), "phrase").limit(1).select(
        F.col("phrase").alias("favorite_phrase"), F.col("occurrences").alias("phrase_occurrences"), F.col("sessions").alias("phrase_sessions")
    )
    best = best.where(F.col("favorite_phrase").rlike(P.CARD_PHRASE))
    row = totals.select("tokens", "sessions").crossJoin(words).crossJoin(tones.select("frustrated", "grateful"))
    return row.join(best, F.lit(True), "left").select(
        "sessions", F.greatest(F.lit(0), "tokens").alias("tokens"), "agent_words", "user_words",
        # The ratio of all words, else that of the averages.
        F.least(F.lit(10_000.0), F.coalesce("agent_user_ratio", F.when(F.col("average_user_words") > 0, F.round(F.col("average_response_words") / F.col("average_user_words"), 2)), F.lit(0.0))).alias("word_ratio"),
        F.col("grateful").alias("grateful_messages"), F.col("frustrated").alias("frustrated_messages"),
        share_score(F.col("grateful"), F.col("frustrated")).alias("good_human_score"), "favorite_phrase", "phrase_occurrences", "phrase_sessions",
    )


def valid_aggregate() -> Column:
    """Whether a flat row may enter the cohort: every number present and in its range."""
    ok = F.lit(True)
    for c, most in (("tokens", 1e13), ("agent_words", 1e10), ("user_words", 1e10), ("word_ratio", 1e4), ("grateful_messages", 1e6), ("frustrated_messages", 1e6)):
        ok = ok & F.coalesce(F.col(c).between(0, most), F.lit(False))
    return ok & (F.col("favorite_phrase").isNull() | F.col("favorite_phrase").rlike(P.CARD_PHRASE)) & F.coalesce(F.col("phrase_sessions") <= F.col("phrase_occurrences"), F.lit(True))


def valid_models(models: Column, total: Column) -> Column:
    """Whether counts by model array<struct<model,count>> may enter the cohort: at most 20 of them, plain names, each once, together the total."""
    counts = F.transform(models, lambda m: m["count"])
    names = F.transform(models, lambda m: m["model"])
    return F.coalesce(
        (F.size(models) <= 20) & F.forall(models, lambda m: m["model"].rlike(r"^[\p{L}\p{N} ._+-]{1,80}$") & m["count"].between(1, 1_000_000)) & (F.size(F.array_distinct(names)) == F.size(names))
        & ((F.size(models) == 0) | (F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x) == total)), F.lit(False),
    )


def slides(shares: DataFrame, label: str, most: int, last: str = "Other") -> DataFrame:
    """The shares a slide shows: displayable ones, largest first, ``last`` behind all others, ``most`` of them, numbered from 1."""
    s = shares.where(F.coalesce(F.round("percent", 1) > 0, F.lit(False)))
    order = [(F.col(label) == last).cast("int"), F.desc("percent"), F.col(label)]
    top = s.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


_DONATED = "type in ('user', 'assistant') and text <> ''"
#: What a donation may hold at most; one that holds more is refused, not cut.
DONATION_SESSIONS, DONATION_MESSAGES, DONATION_TEXT, DONATION_BYTES = 250, 50_000, 20_000, 1_800_000


def _donated(rows: DataFrame) -> DataFrame:
    return rows.where(_DONATED).select("session_id", "i", F.col("type").alias("role"), "text")


def donation_preview(rows: DataFrame, supplied: DataFrame | None = None, summary: int = 110) -> DataFrame:
    """Messages to donate of every session, redacted by the full rules but the heuristic ones: (session_id, i, role, text, session_summary).

    A session without messages is one row without i, role and text.  Its summary is
    the supplied(session_id, summary) one, else the first opening of a user, else of
    the first message.
    """
    redacted = rows.where(_DONATED).select("session_id", "i", F.col("type").alias("role"), redact_full(F.col("text"), heuristic=False).alias("text"))
    opening = redacted.select("session_id", "role", "i", T.opening_prompt(F.col("text")).alias("o"))
    first = opening.groupBy("session_id").agg(
        F.min_by("o", F.when((F.col("role") == "user") & (F.col("o") != ""), F.col("i"))).alias("asked"), F.min_by("o", "i").alias("any")
    )
    told = F.coalesce(F.nullif("asked", F.lit("")), F.nullif("any", F.lit("")), F.lit("Session transcript"))
    told = T.ellipsis(T.one_space(F.regexp_replace(told, r"\[(?:REDACTED|REMOVED)[^\]]*\]", "private detail")), summary)
    sessions = rows.select("session_id").distinct().join(first, "session_id", "left")
    if supplied is not None:
        given = F.nullif(F.substring(T.one_space(F.regexp_replace("summary", r"[\x00-\x1f\x7f]", " ")), 1, 140), F.lit(""))
        sessions = sessions.join(supplied.select("session_id", given.alias("given")), "session_id", "left")
        told = F.coalesce("given", told)
    return sessions.select("session_id", told.alias("session_summary")).join(redacted, "session_id", "left").select("session_id", "i", "role", "text", "session_summary")


def donation_inventory(rows: DataFrame) -> DataFrame:
    """What the preview's redaction found, over all sessions."""
    keys = ["session_id", "i"]
    return inventory(redact_rows(_donated(rows), keys, "text", heuristic=False), keys)


def edited(messages: DataFrame, edits: DataFrame, dropped: DataFrame, with_times: bool = False) -> DataFrame:
    """messages(session_id, i, role, text[, ts]) after a donor's edits(session_id, i, text), where a null text takes a message out, without the dropped(session_id) sessions; times only where asked for."""
    e = edits.select("session_id", "i", F.col("text").alias("__new"), F.lit(True).alias("__edited"))
    out = messages.join(dropped.select("session_id").distinct(), "session_id", "left_anti").join(e, ["session_id", "i"], "left").where("__edited is null or __new is not null")
    return out.withColumn("text", F.coalesce("__new", "text")).drop("__new", "__edited", *([] if with_times else ["ts"]))


def sanitized(messages: DataFrame, consent: bool, mode: str = "standard", unredacted_consent: bool = False) -> DataFrame:
    """messages(session_id, i, role, text) as they may be donated: (session_no, message_no, role, text); no ids leave.

    Control characters go, texts are cut and trimmed, empty ones left out.  The
    query fails without consent, for an unknown mode, and for a donation that is
    empty or above a limit.
    """
    if not consent or mode not in ("standard", "custom", "unredacted") or mode == "unredacted" and not unredacted_consent:
        raise ValueError("no consent to this donation")
    text = T.trimmed(F.substring(F.regexp_replace(T.nfkc(F.col("text")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), 1, DONATION_TEXT))
    m = materialize(messages.where(F.col("role").isin("user", "assistant")).select("session_id", "i", "role", text.alias("text")).where("text <> ''"), "donation")
    size = m.agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("s"), F.sum(F.octet_length(F.to_json(F.struct("role", "text")))).alias("b"))
    ok = (F.col("n") > 0) & (F.col("s") <= DONATION_SESSIONS) & (F.col("n") <= DONATION_MESSAGES) & (F.col("b") <= DONATION_BYTES)
    checked = size.select(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("the donation is empty or too large"))).alias("ok"))
    # Small by now: a donation within the limits has 50 000 messages at most.
    numbered = m.select("session_id").distinct().withColumn("session_no", F.row_number().over(Window.orderBy("session_id")))
    out = m.join(numbered, "session_id").withColumn("message_no", F.row_number().over(Window.partitionBy("session_id").orderBy("i")))
    return out.crossJoin(checked).where("ok").select("session_no", "message_no", "role", "text")


def sealed(payload: Column, key: Column, iv: Column, aad: Column) -> Column:
    """A payload encrypted by AES-256 in GCM with additional data, as base64; wrapping the key is left to the caller."""
    return F.base64(F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad))


def opened(sealed_text: Column, key: Column, aad: Column) -> Column:
    """The payload of a sealed text; the query fails if it was changed."""
    return F.aes_decrypt(F.unbase64(sealed_text), key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")


def valid_envelope(envelope: Column) -> Column:
    """Whether JSON is an envelope of a sealed donation: just these keys, base64url parts of the right sizes, bounded counts, consent that fits the mode."""
    v = F.from_json(envelope, (
        "format string, encryption struct<algorithm:string,keyId:string,wrappedKey:string,iv:string,authTag:string>, ciphertext string, metadata struct<reportId:string,redactionMode:string,"
        "createdAt:string,consentedAt:string,consentVersion:int,unredactedData:boolean,automatedDetections:long,sessions:long,messages:long>"
    ))
    enc, meta = v["encryption"], v["metadata"]
    just = lambda path, names: F.array_sort(F.json_object_keys(F.get_json_object(envelope, path))) == F.array(*(F.lit(n) for n in sorted(names.split())))
    part = lambda c, lo, hi: c.rlike("^[A-Za-z0-9_-]+$") & F.length(c).between(lo, hi)
    time = r"^\d{4}-\d{2}-\d{2}T"
    return F.coalesce(
        just("$", "format encryption ciphertext metadata") & just("$.encryption", "algorithm keyId wrappedKey iv authTag")
        & just("$.metadata", "reportId redactionMode createdAt consentedAt consentVersion unredactedData automatedDetections sessions messages")
        & part(enc["wrappedKey"], 480, 700) & part(enc["iv"], 16, 16) & part(enc["authTag"], 22, 22) & part(v["ciphertext"], 1, -(-DONATION_BYTES // 3) * 4) & meta["reportId"].rlike("^[A-Za-z0-9_-]{8,32}$")
        & meta["redactionMode"].isin("standard", "custom", "unredacted") & meta["createdAt"].rlike(time) & meta["consentedAt"].rlike(time) & meta["consentVersion"].isin(1, 2)
        & (meta["unredactedData"] == (meta["redactionMode"] == "unredacted")) & meta["automatedDetections"].between(0, 1_000_000) & meta["sessions"].between(1, DONATION_SESSIONS) & meta["messages"].between(1, DONATION_MESSAGES),
        F.lit(False),
    )
