"""Languages, topics and tone of what users and agents write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import patterns as P
from threadloom.functions import text as T
from threadloom.operators.evidence import aggregate_safe
from threadloom.operators.ordered import running
from threadloom.operators.stats import PROMPT, session_tokens, turns


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _first_best(names: list[str], scores: Column) -> Column:
    """The first of the names with the best score."""
    return F.element_at(F.array(*(F.lit(n) for n in names)), F.array_position(scores, F.array_max(scores)).cast("int"))


def chunk_language(c: Column) -> Column:
    """Language of a sentence: a script with at least 2 letters and 15 % of them, else the lexicon with most words (2 at least), else English; null without letters."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    counts = F.array(*(F.regexp_count(c, F.lit(f"[{java}]")) for _, java, _ in P.SCRIPTS))
    script = F.when(c.rlike(r"[^\x00-\x7f]"), _let(counts, lambda n: F.when((F.array_max(n) >= 2) & (F.array_max(n) * 100 >= letters * 15), _first_best([k for k, _, _ in P.SCRIPTS], n))))
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\p{IsLatin}+(?:['’]\p{IsLatin}+)*"), F.lit(0)))

    def lexicon(w: Column) -> Column:
        scores = F.array(*(F.size(F.array_intersect(w, F.array(*(F.lit(x) for x in v.split())))) for v in P.LEXICONS.values()))
        return F.when(F.size(w) > 0, _let(scores, lambda n: F.when(F.array_max(n) >= 2, _first_best(list(P.LEXICONS), n)).otherwise("English")))

    return F.when(letters > 0, F.coalesce(script, _let(words, lexicon)))


def language_share(rows: DataFrame, where: str = "type in ('user', 'assistant')") -> DataFrame:
    """Words by language over the sentences with two words or more, and their share."""
    s = rows.where(where).select(F.explode(T.sentences(T.analysis_prose(F.col("text")))).alias("s"))
    s = s.select(T.word_count(F.col("s")).alias("words"), chunk_language(F.col("s")).alias("language")).where("words >= 2")
    # Unknown languages go after the aggregation, else the filter would classify every sentence a second time.
    n = s.groupBy("language").agg(F.sum("words").alias("words"), F.count("language").alias("known")).where("known > 0").drop("known")
    return n.withColumn("percent", F.floor(F.col("words") * 1000 / F.sum("words").over(Window.partitionBy()) + 0.5) / 10)


#: Words of a script as a pattern can tell them: runs of letters that hold one of it; without spaces so many characters make one.
_UNSPACED = {"Japanese": 3, "Chinese": 2, "Thai": 4}


def script_words(name: str, letters: str) -> str:
    """A pattern that matches each word of a script; ``letters`` is the script as the engine names it."""
    return f"[{letters}]{{1,{_UNSPACED[name]}}}" if name in _UNSPACED else rf"[\p{{L}}\p{{M}}\p{{N}}]*[{letters}][\p{{L}}\p{{M}}\p{{N}}]*"


def language_anomaly(rows: DataFrame) -> DataFrame:
    """Words of foreign scripts in agents' answers that neither the session's language nor the prompt explains.

    (language, words, occurrences) over all responses; a script counts with two
    words or more per response; Chinese doesn't where kana stand; a session's
    language is that of all its answers together.
    """
    t = turns(rows.select("session_id", "i", "type", "is_meta", "text"))
    prose = t.where(f"type = 'assistant' or {PROMPT}").select("session_id", "turn", "type", T.analysis_prose(F.col("text")).alias("p")).withColumn("wide", F.col("p").rlike(r"[^\x00-\x7f]"))
    said, asked = F.col("type") == "assistant", F.col("type") == "user"
    word = {k: F.regexp_count("p", F.lit(script_words(k, java))) for k, java, _ in P.SCRIPTS}
    letter = {k: F.regexp_count("p", F.lit(f"[{java}]")) for k, java, _ in P.SCRIPTS}
    latin = F.array_distinct(F.regexp_extract_all(F.lower("p"), F.lit(r"\p{IsLatin}+(?:['’]\p{IsLatin}+)*"), F.lit(0)))
    known = F.array_intersect(latin, F.array(*(F.lit(w) for w in sorted({w for v in P.LEXICONS.values() for w in v.split()}))))
    per = prose.groupBy("session_id", "turn").agg(
        *(F.sum(F.when(said & F.col("wide"), c).otherwise(0)).alias(f"w_{k}") for k, c in word.items()), *(F.sum(F.when(said & F.col("wide"), c).otherwise(0)).alias(f"s_{k}") for k, c in letter.items()),
        *(F.max(F.when(asked & F.col("wide"), F.col("p").rlike(f"[{java}]")).otherwise(F.lit(False))).alias(f"u_{k}") for k, java, _ in P.SCRIPTS),
        F.sum(F.when(said, F.regexp_count("p", F.lit(r"\p{L}"))).otherwise(0)).alias("letters"), F.max(said & F.col("p").rlike(r"\p{IsLatin}")).alias("latin"),
        # Only words of the lexicons are kept, so the sets are bounded by them.
        F.array_distinct(F.flatten(F.collect_set(F.when(said, known)))).alias("known"),
    )
    main = per.groupBy("session_id").agg(
        *(F.sum(f"s_{k}").alias(f"s_{k}") for k in letter), F.sum("letters").alias("letters"), F.max("latin").alias("latin"), F.array_distinct(F.flatten(F.collect_set("known"))).alias("known")
    )
    most = F.greatest(*(F.col(f"s_{k}") for k in letter))
    script = F.coalesce(*(F.when((F.col(f"s_{k}") == most) & (most >= 2) & (most * 100 >= F.col("letters") * 15), k) for k in letter))
    score = F.array(*(F.size(F.array_intersect("known", F.array(*(F.lit(x) for x in v.split())))) for v in P.LEXICONS.values()))
    lexicon = F.when(F.col("latin"), _let(score, lambda n: F.when(F.array_max(n) >= 2, _first_best(list(P.LEXICONS), n)).otherwise("English")))
    j = per.join(main.where("letters > 0").select("session_id", F.coalesce(script, lexicon).alias("dominant")), "session_id").where("dominant is not null")
    each = j.select("dominant", F.inline(F.array(*(F.struct(F.lit(k).alias("language"), F.col(f"w_{k}").alias("words"), F.col(f"u_{k}").alias("asked")) for k in word))), F.col("s_Japanese").alias("kana"))
    bad = each.where((F.col("words") >= 2) & ~F.col("asked") & (F.col("language") != F.col("dominant")) & ~((F.col("language") == "Chinese") & (F.col("kana") > 0)))
    return bad.groupBy("language").agg(F.sum("words").alias("words"), F.count("*").alias("occurrences"))


def topic_scores(c: Column) -> list[tuple[str, Column]]:
    return [(name, T.occurrences(c, p)) for name, p in P.TOPICS]


def direct_topic(c: Column) -> Column:
    """The topic with most keywords, null without any; ties in rule order."""
    scores = topic_scores(c)
    best = F.greatest(*(s for _, s in scores))
    out = F.lit(None).cast("string")
    for k, s in reversed(scores):
        out = F.when((s == best) & (best > 0), k).otherwise(out)
    return out


def prompt_topics(rows: DataFrame) -> DataFrame:
    """Prompts with their topic; short ones without keywords inherit the session's last topic, others are 'Other'."""
    p = rows.where(PROMPT).select("session_id", "i", "text")
    p = p.withColumn("own", direct_topic(F.col("text"))).withColumn("words", T.word_count(F.col("text")))
    p = running(p, lasts={"inherited": F.col("own")})
    return p.select("session_id", "i", F.coalesce("own", F.when(F.col("words") <= 8, F.col("inherited")), F.lit("Other")).alias("topic"))


def topic_share(rows: DataFrame) -> DataFrame:
    n = prompt_topics(rows).groupBy("topic").agg(F.count("*").alias("prompts"))
    return n.withColumn("percent", F.floor(F.col("prompts") * 1000 / F.sum("prompts").over(Window.partitionBy()) + 0.5) / 10)


def topic_openings(rows: DataFrame, per_session: int = 3) -> DataFrame:
    """The first safe openings of each session: (session_id, n, opening)."""
    text = T.one_space(aggregate_safe(T.tone_prose(F.col("text"))))
    p = rows.where(PROMPT).select("session_id", "i", text.alias("text")).where(~F.col("text").rlike(r"(?i)\[(?:REDACTED|REMOVED)[^\]]*\]"))
    p = p.select("session_id", "i", T.ellipsis(F.col("text"), 180).alias("opening")).where(T.share_safe(F.col("opening"), 2, 180))
    return p.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("i"))).where(F.col("n") <= per_session).select("session_id", "n", "opening")


def topic_bundle(rows: DataFrame, most: int = 250) -> DataFrame:
    """Every session with its tokens and standing: one of the first ``most`` candidates (by latest start), overflow, or without an opening.

    (session_id, standing, place, tokens): a judge gets the candidates, the tokens of the others stay unclassified.
    """
    starts = rows.groupBy("session_id").agg(F.min("ts").alias("started_at"))
    told = topic_openings(rows, 1).select("session_id", F.lit(True).alias("told"))
    s = session_tokens(rows).join(starts, "session_id").join(told, "session_id", "left")
    order = [F.col("started_at").desc_nulls_last(), F.col("session_id")]
    chosen = s.where("told").orderBy(*order).limit(most).select("session_id", F.row_number().over(Window.orderBy(*order)).alias("place"))
    return s.join(chosen, "session_id", "left").select(
        "session_id", F.when(F.col("place").isNotNull(), "candidate").when(F.col("told"), "overflow").otherwise("no opening").alias("standing"), "place", "tokens"
    )


def apply_topics(local: DataFrame, judged: DataFrame) -> DataFrame:
    """The judged topics if there are any, else the local ones; both (topic, tokens, percent)."""
    some = judged.agg((F.count("*") > 0).alias("some"))
    return judged.unionByName(local.crossJoin(some).where("not some").drop("some"))


def topic_weights(rows: DataFrame, verdicts: DataFrame, least: float = 0.65) -> DataFrame:
    """Token-weighted topics from verdicts(session_id, topic, confidence); unsure and missing ones are 'Other'."""
    w = session_tokens(rows).join(verdicts, "session_id", "left")
    topic = F.when(F.col("confidence") >= least, F.col("topic")).otherwise("Other")
    n = w.groupBy(F.coalesce(topic, F.lit("Other")).alias("topic")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    return n.withColumn("percent", F.floor(F.col("tokens") * 1000 / F.sum("tokens").over(Window.partitionBy()) + 0.5) / 10)


def keyword_verdicts(rows: DataFrame) -> DataFrame:
    """A deterministic local judge of session topics: the topic of most keywords in its prompts and that topic's share."""
    s = rows.where(PROMPT).select("session_id", *(c.cast("long").alias(f"t{k}") for k, (_, c) in enumerate(topic_scores(F.col("text")))))
    s = s.groupBy("session_id").agg(*(F.sum(f"t{k}").alias(f"t{k}") for k in range(len(P.TOPICS))))
    cols = [F.col(f"t{k}") for k in range(len(P.TOPICS))]
    best, total = F.greatest(*cols), sum(cols[1:], cols[0])
    out = F.lit(None).cast("string")
    for k, (name, _) in reversed(list(enumerate(P.TOPICS))):
        out = F.when((cols[k] == best) & (best > 0), name).otherwise(out)
    return s.select("session_id", out.alias("topic"), F.when(total > 0, best / total).otherwise(0.0).alias("confidence"))


# ---- tone --------------------------------------------------------------------


def _priority(text: Column, words: Column, n: Column) -> Column:
    score = F.lit(0)
    for p, weight in ((P.STRONG_FRUSTRATION, 20), (P.STRONG_GRATITUDE, 20), (P.TONE, 8), (r"\b(?:you|your|agent|assistant)\b", 3)):
        score = score + F.when(T.matches(text, p), weight).otherwise(0)
    return score + F.when(text.rlike("[!?]{2,}"), 3).otherwise(0) + F.when(words <= 40, 2).otherwise(0) + F.least(F.lit(3), n)


#: Sentences as far as their ends tell, and marks of redaction (as a string of SQL).
SENTENCE = r"[^.!?。！？]+[.!?。！？]*"
_MARKED = r"\\[(?:REDACTED|REMOVED)[^\\]]*\\]"


def tone_candidates(rows: DataFrame, most: int = 120) -> DataFrame:
    """Distinct user messages worth a look at their tone, by priority: (rank, text, occurrences)."""
    text = T.one_space(aggregate_safe(T.tone_prose(F.col("text"))))
    m = rows.where("type = 'user' and not is_meta").select("rec_id", text.alias("text")).where(f"text <> '' and not text rlike '(?i){_MARKED}'")
    # The first sentence with a word of tone, else the first one.
    parts = F.filter(F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), lambda p: F.trim(p)), lambda p: p != "")
    first = F.coalesce(F.try_element_at(F.filter(parts, lambda p: T.matches(p, P.TONE)), F.lit(1)), F.try_element_at(parts, F.lit(1)), F.col("text"))
    m = m.select("rec_id", T.ellipsis(first, 240).alias("text"))
    m = m.where(T.share_safe(F.col("text"), 2, 240, 32)).withColumn("words", F.regexp_count("text", F.lit(r"\p{L}+")))
    m = m.where(T.matches(F.col("text"), P.TONE) | (F.col("words") <= 40) | F.col("text").rlike("[!?]{2,}"))
    g = m.groupBy(F.lower(T.nfkc(F.col("text"))).alias("key")).agg(F.min_by("text", "rec_id").alias("text"), F.min_by("words", "rec_id").alias("words"), F.count("*").alias("occurrences"), F.min("rec_id").alias("first_seen"))
    g = g.withColumn("priority", _priority(F.col("text"), F.col("words"), F.col("occurrences")))
    top = g.orderBy(F.desc("priority"), F.desc("occurrences"), "first_seen").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("priority"), F.desc("occurrences"), "first_seen"))
    return top.select(rank.alias("rank"), "text", "occurrences", "priority")


def tone_batches(candidates: DataFrame, size: int = 30) -> DataFrame:
    """Candidates in batches with their number inside the batch."""
    return candidates.select(F.expr(f"cast((rank - 1) div {size} as int)").alias("batch"), F.expr(f"cast(pmod(rank - 1, {size}) + 1 as int)").alias("batch_rank"), "rank")


def keyword_tones(candidates: DataFrame) -> DataFrame:
    """A deterministic local judge of tone: verdicts(rank, frustrated, grateful, confidence)."""
    t = F.col("text")
    return candidates.select("rank", T.is_frustrated(t).alias("frustrated"), T.is_grateful(t).alias("grateful"), F.when(T.matches(t, P.STRONG_FRUSTRATION) | T.matches(t, P.STRONG_GRATITUDE), 0.9).otherwise(0.75).alias("confidence"))


def tone_result(candidates: DataFrame, verdicts: DataFrame, least: float = 0.75) -> DataFrame:
    """One row: messages judged, frustrated, grateful, and the confidence weighted by occurrences.

    Verdicts without a candidate, repeated ones and unsure ones are dropped.
    """
    v = verdicts.where(F.col("confidence") >= least).groupBy("rank").agg(F.first("frustrated").alias("frustrated"), F.first("grateful").alias("grateful"), F.max("confidence").alias("confidence"))
    j = candidates.join(v, "rank")
    n = F.col("occurrences")
    return j.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("candidate_messages"), F.coalesce(F.sum(F.when(F.col("frustrated"), n)), F.lit(0)).alias("frustrated"),
        F.coalesce(F.sum(F.when(F.col("grateful"), n)), F.lit(0)).alias("grateful"), (F.floor(F.sum(F.col("confidence") * n) / F.sum(n) * 100 + 0.5) / 100).alias("confidence"),
    )


def exact_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The verdicts(rank, frustrated, grateful, ...) if each candidate is judged exactly once and both flags are given; else none."""
    judged = verdicts.groupBy("rank").agg(F.count("*").alias("n"), F.max(F.col("frustrated").isNull() | F.col("grateful").isNull()).alias("open"))
    bad = candidates.select("rank", F.lit(1).alias("c")).join(judged, "rank", "full").agg(F.count_if(F.col("n").isNull() | F.col("c").isNull() | (F.col("n") > 1) | F.col("open")).alias("bad"))
    return verdicts.crossJoin(bad).where("bad = 0").drop("bad")


def funniest(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row at most: the first candidate that a verdict of any batch calls frustrated, as (rank, text)."""
    flagged = verdicts.where("frustrated").select("rank").distinct()
    return candidates.join(flagged, "rank", "left_semi").orderBy("rank").limit(1).select("rank", "text")


def apply_tone(local: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: the local count of messages looked at, frustrated and grateful ones as judged where something was, else noughts and no confidence."""
    j = judged.select(F.col("frustrated").alias("j_frustrated"), F.col("grateful").alias("j_grateful"), "candidate_messages", "confidence")
    return local.select("analyzed").join(j, F.lit(True), "left").select(
        "analyzed", F.coalesce("j_frustrated", F.lit(0)).alias("frustrated"), F.coalesce("j_grateful", F.lit(0)).alias("grateful"), F.coalesce("candidate_messages", F.lit(0)).alias("candidate_messages"), "confidence"
    )


def frustration_quotes(rows: DataFrame, most: int = 40) -> DataFrame:
    """Distinct short quotes of frustrated users, the liveliest first."""
    m = rows.where("type = 'user' and not is_meta").where(T.is_frustrated(F.col("text")))
    m = m.select("rec_id", T.one_space(aggregate_safe(T.tone_prose(F.col("text"), tags=False))).alias("text")).where(f"text <> '' and not text rlike '(?i){_MARKED}'")
    parts = F.filter(F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), lambda p: F.trim(p)), lambda p: p != "")
    first = F.try_element_at(F.filter(parts, T.is_frustrated), F.lit(1))
    q = m.select("rec_id", T.ellipsis(F.coalesce(first, F.col("text")), 150).alias("quote")).where(T.share_safe(F.col("quote"), 6, 150, 32))
    q = q.groupBy("quote").agg(F.min("rec_id").alias("first_seen"))
    t = F.col("quote")
    score = (
        F.when(T.matches(t, r"\b(?:bro|bruh|dude|come on|seriously|wtf|wth)\b"), 4).otherwise(0) + F.when(t.rlike("[!?]{2,}"), 2).otherwise(0)
        + F.when(F.length(t).between(20, 150), 1).otherwise(0) + F.least(F.lit(2), T.occurrences(t, r"\b[A-Z]{4,}\b", False))
    )
    return q.withColumn("score", score).orderBy(F.desc("score"), F.length("quote"), "first_seen").limit(most).select("quote", "score")
