"""Requests to judges as rows, and what a diagnostic may show of them.

A judge is any callable from a request to a reply; the engine only builds the
requests (candidates, the ids that may be answered, the shape of the answer) and
reads replies back as verdict rows.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import patterns as P
from threadloom.operators.evidence import leak

#: kind -> (candidates at most, fields of one verdict as DDL, whether one verdict in all or one per candidate is asked for).
KINDS = {
    "phrase": (100, "candidate_id string", False), "quote": (40, "candidate_id string", False), "tone": (120, "candidate_id string, frustrated boolean, grateful boolean", True),
    "topic": (250, "candidate_id string, topic string, confidence double, summary string", True),
    "workaround": (12, "session_id string, blocker bigint, decision string, original bigint, alternative bigint, reason string, disclosure string, confidence string", True),
}


def requests(candidates: DataFrame, kind: str, instructions: str, id_column: str = "candidate_id", batch: Column | None = None) -> DataFrame:
    """(batch, n, request): one JSON request per batch of candidates, with the ids that may be answered.

    The query fails if a batch is larger than its kind allows or holds a private
    value; candidates are bounded by that, so a request fits one row.
    """
    most, verdict, each = KINDS[kind]
    rows = candidates.withColumn("batch", F.lit(0) if batch is None else batch)
    fields = [c for c in rows.columns if c != "batch"]
    # Sizes first, so a batch that is too large is never collected.
    size = rows.groupBy("batch").agg(F.count("*").alias("n"))
    ok = F.when(F.col("n") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"a {kind} request has {most} candidates at most")))
    fit = rows.join(size.where(ok).select("batch", "n"), "batch")
    listed = fit.groupBy("batch").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(id_column, *[c for c in fields if c != id_column]))).alias("candidates"))
    body = F.to_json(F.struct(
        F.lit(kind).alias("judge"), F.lit(instructions).alias("instructions"), "candidates",
        F.struct(F.lit(verdict).alias("verdict"), F.when(F.lit(each), F.col("n")).otherwise(1).alias("verdicts"), F.transform("candidates", lambda c: c[id_column]).alias("ids")).alias("answer"),
    ))
    return listed.select("batch", "n", F.when(leak(body), F.raise_error(F.lit("a request holds a private value"))).otherwise(body).alias("request"))


def verdicts(replies: DataFrame, kind: str) -> DataFrame:
    """replies(batch, content) -> the verdicts they hold, one row each; replies that hold none give none."""
    from threadloom.functions.text import repaired_json

    schema = KINDS[kind][1]
    j = F.from_json(repaired_json(F.col("content")), f"verdicts array<struct<{', '.join(':'.join(f.split(' ')) for f in schema.split(', '))}>>")
    return replies.select("batch", F.inline(j["verdicts"]))


MAX_DEPTH = 4


def safe_value(value: object, depth: int = 0) -> object:
    """What a diagnostic may show of a value: four levels below it, 20 items and 30 keys a level, texts of 300 characters; secrets and their keys are left out."""
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return value if abs(value) < float("inf") else None
    if isinstance(value, str):
        text = " ".join(re.sub(r"[\x00-\x1f\x7f]", " ", unicodedata.normalize("NFKC", value)).split())[:300]
        return "[REDACTED]" if re.search(P.BLOCKED_VALUE, text) else text
    inner = depth < MAX_DEPTH
    if isinstance(value, (list, tuple)):
        return [safe_value(v, depth + 1) for v in value[:20]] if inner else []
    if isinstance(value, dict):
        return {str(k): safe_value(v, depth + 1) for k, v in list(value.items())[:30] if not re.search(P.BLOCKED_KEY, str(k))} if inner else {}
    return None
