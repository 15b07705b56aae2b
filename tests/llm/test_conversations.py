"""Session faults against a plain walk over each session's rows."""

from collections import defaultdict
from datetime import datetime, timedelta, timezone

from threadloom.llm import conversations
from threadloom.session import read_table
from tests.conftest import block, record

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def walk(sessions, records):
    by = defaultdict(list)
    for r in records:
        if r.session_id is not None:
            by[r.session_id.strip().lower()].append(r)
    out = set()
    for s in {x.strip().lower() for x in sessions if x is not None}:
        rows = by.get(s, [])
        first = {}
        for r in rows:
            if r.record_index is not None and (r.uuid not in first or r.record_index < first[r.uuid].record_index):
                first[r.uuid] = r
        times = [(r.ts, r.record_index) for r in first.values() if r.ts is not None]

        def place(r):
            if r.record_index is not None:
                return (r.record_index, -1, r.rec_id)
            return (max((i for t, i in times if t <= r.ts), default=-1), r.ts.timestamp(), r.rec_id)

        seen, parts, used, broken = set(), [], set(), False
        for r in sorted(rows, key=place):
            key = r.uuid or f"row {r.rec_id}"
            if key in seen:
                continue
            seen.add(key)
            blocks = (r.message.content if r.message else None) or []
            if r.rec_type in ("user", "assistant"):
                broken |= not ((r.message.role if r.message else None) or "").strip()
                if not r.is_meta and not r.is_api_error and any(b.type == "text" and (b.text or "").strip() for b in blocks):
                    parts.append(r.rec_type)
            for b in blocks:
                if b.type == "tool_use":
                    used.add(b.id)
                elif b.type == "tool_result" and b.tool_use_id is not None:
                    broken |= b.tool_use_id not in used
        if not parts:
            out.add((s, "empty"))
        elif parts[0] == "assistant":
            out.add((s, "headless"))
        if any(p == "user" and (k + 1 == len(parts) or parts[k + 1] == "user") for k, p in enumerate(parts)):
            out.add((s, "unanswered"))
        if broken:
            out.add((s, "broken"))
    return out


def test_tables_match_for_any_cells(spark, data):
    sessions, records = read_table(spark, data, "sessions"), read_table(spark, data, "records")
    want = walk([r.session_id for r in sessions.collect()], records.collect())
    for cells in (1, 7, None):
        assert {tuple(r) for r in conversations.faults(sessions, records, cells).collect()} == want


def test_dirty_rows(spark, make_records):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        record(1, " S1\n", index=0, ts=at(0), text="ask"), record(2, "s1", index=1, ts=at(5), type="assistant", text="answer"), record(3, "s1", uuid="late", index=None, ts=at(2), text="late ask"),
        record(4, "s1", uuid="u2", index=9, ts=at(5), type="assistant", text="answer"),
        record(5, "s2", type="assistant", role=None, text="x"), record(6, "s3", text=" 　\t"), record(7, "s4", error=True, type="assistant", text="API"), record(8, None, text="lost"),
        record(9, "s5", index=0, text="q"), record(10, "s5", index=1, type="assistant", blocks=[block("tool_use", id="t"), block(text="a")]), record(11, "s5", index=2, meta=True, blocks=[block("tool_result", tool_use_id="t")]),
        record(12, "s6", index=0, type="assistant", blocks=[block("tool_result", tool_use_id="zz")], role=" "),
    ]
    df = make_records(rows).withColumnRenamed("cwd", "cell")  # an extra column with a name used inside
    sessions = spark.createDataFrame([(f"s{k}",) for k in range(1, 8)] + [(None,), ("s7",)], "session_id string")
    got = {tuple(r) for r in conversations.faults(sessions, df).collect()}
    assert got == {("s1", "unanswered"), ("s2", "headless"), ("s2", "broken"), ("s3", "empty"), ("s4", "empty"), ("s6", "empty"), ("s6", "broken"), ("s7", "empty")}
    c = conversations.conversations(sessions, df).orderBy("session_id", "message_no").collect()
    assert [(r.session_id, r.turn_no, r.message_no, r.speaker, r.text) for r in c] == [("s5", 1, 1, "user", "q"), ("s5", 1, 2, "assistant", "a")]


def test_empty_tables(spark, make_records):
    none = spark.createDataFrame([], "session_id string")
    assert conversations.faults(none, make_records([])).count() == 0
    assert conversations.faults(spark.createDataFrame([("a",)], "session_id string"), make_records([])).collect()[0].fault == "empty"


def _said(spark, make_records, rows, **kw):
    sessions = spark.createDataFrame([("s1",)], "session_id string")
    got = conversations.conversations(sessions, make_records(rows), drop_faulty=False, **kw).orderBy("message_no").collect()
    return [(r.speaker, r.text, r.n_versions) for r in got]


def test_log_is_folded_by_version(spark, make_records):
    """Retries, edits and deletes; split messages; whatever the order of arrival."""
    as_op = lambda r, op: (*r[:13], op, *r[14:])
    rows = [
        record(7, uuid="q", index=6, text="retry, ignored"), record(1, uuid="q", index=0, text="ask"), record(2, uuid="a", index=1, type="assistant", text="first answer"),
        as_op(record(9, uuid="a", index=8, type="assistant", text="last answer"), "edit"), as_op(record(8, uuid="a", index=7, type="assistant", text="middle"), "edit"),
        record(3, uuid="gone", index=2, text="delete me"), as_op(record(10, uuid="gone", index=9), "delete"), as_op(record(11, uuid="never", index=10), "delete"),
        record(4, uuid="m1", index=3, type="assistant", message_id="m", text="part one"), record(5, uuid="m2", index=4, type="assistant", message_id="m", text="part two"), record(6, uuid="m2", index=5, type="assistant", message_id="m", text="again"),
    ]
    want = [("user", "ask", 2), ("assistant", "last answer", 3), ("assistant", "part one\npart two", 3)]
    assert _said(spark, make_records, rows) == want and _said(spark, make_records, rows[::-1], cells=5) == want


def test_session_without_record_index_falls_into_many_cells(spark, make_records):
    n = 4000
    df = spark.range(n).selectExpr("id as rec_id").join(make_records([record(0, index=None)]).drop("rec_id", "uuid", "ts"), how="cross").selectExpr(
        "*", "concat('u', rec_id) as uuid", "timestamp_micros(rec_id) as ts").select(*make_records([]).columns)
    folded = conversations.fold(spark.createDataFrame([("s1",)], "session_id string"), df, cells=8)
    sizes = [r["count"] for r in folded.groupBy("session_id", "cell").count().collect()]
    assert sum(sizes) == n and len(sizes) == 8 and max(sizes) < n / 4
    order = [r.rec_id for r in folded.orderBy("cell", "pos", "sub", "rec_id").select("rec_id").collect()]
    assert order == list(range(n))
