"""Every registered core query against its SQL in DuckDB; the rest against plain Python or what must hold."""

from collections import Counter
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from threadloom.plans.catalog import QUERIES, SQL

SLOW = {"neardup_families", "p1_records"}  # tested in test_definitions and test_drift


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


# ---- queries that SQL can't say, against plain Python or what must hold ------


@pytest.fixture(scope="module")
def texts(spark, data):
    from threadloom.operators.ordered import canonical
    from threadloom.session import read_table

    return [r.text for r in canonical(read_table(spark, data, "records")).select("text", "type").collect()]


def test_no_query_is_left_out():
    assert set(QUERIES) - set(SQL) - SLOW == {"codex_records", "text_parts", "phrase_suppressed", "ngram_suppressed", "family_counters", "redaction_inventory", "donation_inventory"}


def _found(rows):
    return Counter({(r.kind, r.value): r.n for r in rows})


def test_inventories(spark, data, db, texts):
    from threadloom.operators.redaction import redact

    for name, own in (("redaction_inventory", texts), ("donation_inventory", None)):
        own = _donated(spark, data) if own is None else own
        want = Counter((d["kind"], d["value"]) for t in own for d in redact(t, heuristic=False)[1])
        rows = QUERIES[name](spark, data).collect()
        assert _found(rows) == want and want
        assert all(len(r.contexts) == min(6, r.n) for r in rows)
        assert [r.kind_place for r in sorted(rows, key=lambda r: -r.kind_n)] == sorted(r.kind_place for r in rows)


def _donated(spark, data):
    from threadloom.operators.ordered import canonical
    from threadloom.session import read_table

    return [r.text for r in canonical(read_table(spark, data, "records")).where("type in ('user', 'assistant') and text <> ''").select("text").collect()]


def test_text_parts(spark, data, db):
    from threadloom.operators.evidence import trajectory_text
    from threadloom.session import read_table
    from pyspark.sql import functions as F

    whole = {r.doc_id: r.t or "" for r in read_table(spark, data, "documents").select("doc_id", trajectory_text(F.col("text")).alias("t")).collect()}
    got: dict = {}
    for r in QUERIES["text_parts"](spark, data).orderBy("doc_id", "part_no").collect():
        assert 2 <= len(r.part) <= 600
        got.setdefault(r.doc_id, []).append(r.part)
    for k, t in whole.items():
        if len(got.get(k, [])) and sum(map(len, got[k])) >= len(t) - len(got[k]):
            assert "".join(got[k]).replace(" ", "") == t.replace(" ", "")
    assert len(got) > len(whole) * 0.7


@pytest.mark.parametrize("name, every, most", [("phrase_suppressed", "phrase_candidates", 100), ("ngram_suppressed", None, 50)])
def test_suppressed(spark, data, name, every, most):
    rows = QUERIES[name](spark, data).collect()
    assert 0 < len(rows) <= most and [r.candidate_id for r in rows] == [f"phrase-{k + 1}" for k in range(len(rows))]
    for k, r in enumerate(rows):
        for o in rows[:k]:
            nested = f" {r.phrase} " in f" {o.phrase} " or f" {o.phrase} " in f" {r.phrase} "
            assert not nested or min(r.occurrences, o.occurrences) / max(r.occurrences, o.occurrences) < 0.72
    if every:
        known = {r.phrase: r.occurrences for r in QUERIES[every](spark, data).collect()}
        assert all(known[r.phrase] == r.occurrences for r in rows)


def test_family_counters(spark, data):
    c = QUERIES["family_counters"](spark, data).first()
    assert c.accepted_pairs == QUERIES["neardup_pairs"](spark, data).count() and c.variants == QUERIES["phrase_variants"](spark, data).count()
    assert c.accepted_pairs <= c.verified_pairs <= c.candidate_pairs <= c.all_pairs and c.units >= c.variants and c.messages > 0 and c.sessions > 0


def test_codex_records(spark, data):
    """Each kept line once, densely numbered, messages and usage as a plain walk over the lines finds them."""
    import json

    from threadloom.operators.drift import parse_object
    from threadloom.session import read_table

    files = {r.file_id for r in read_table(spark, data, "raw_files").where("agent = 'codex'").collect()}
    said: Counter = Counter()
    for r in read_table(spark, data, "raw_lines").collect():
        o = parse_object(r.raw) if r.file_id in files else None
        p = (o or {}).get("payload")
        if o and o.get("type") == "response_item" and isinstance(p, dict) and p.get("type") == "message" and isinstance(p.get("content"), list):
            texts = [b["text"] for b in p["content"] if isinstance(b, dict) and b.get("type") in ("input_text", "output_text", "text") and isinstance(b.get("text"), str)]
            if texts:
                said["assistant" if p.get("role") == "assistant" else "user", "\n".join(texts)] += 1
    rows = QUERIES["codex_records"](spark, data).collect()
    assert Counter((r.kind, r.text) for r in rows if r.kind in ("user", "assistant")) == said
    by = {}
    for r in rows:
        by.setdefault(r.session_id, []).append(r.i)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and rows
    assert all(min(json.loads(r.text).values()) >= 0 for r in rows if r.kind == "usage")
