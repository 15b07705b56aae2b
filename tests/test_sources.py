"""Transcript files, normalisers and streams on small hand-made inputs."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from threadloom.operators import normalize
from threadloom.sources import jsonl
from threadloom.streaming import streams


def envelope(*events):
    return [json.dumps({"timestamp": f"2026-01-01T00:00:{k:02d}Z", "type": t, "payload": p}) for k, (t, p) in enumerate(events)]


def lines_df(spark, lines, session="s"):
    return spark.createDataFrame([(session, k, x) for k, x in enumerate(lines)], "session_id string, line_no int, raw string")


def usage(i, o, w=0, c=0):
    return ("event_msg", {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "output_tokens": o, "cache_write_input_tokens": w, "cached_input_tokens": c}}})


def test_files_are_numbered_and_bad_lines_dropped(spark, tmp_path):
    p = tmp_path / "proj" / "a.jsonl"
    p.parent.mkdir()
    rec = {"type": "user", "uuid": "u", "sessionId": "S", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "hello"}}
    tool = {"type": "assistant", "uuid": "v", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "c", "name": "Read", "input": {"file": "x"}}], "usage": {"input_tokens": 3}}}
    p.write_text(json.dumps(rec) + "\r\n\n{broken\n" + json.dumps(tool) + "\n" + json.dumps({"type": "x", "message": {"content": "y" * 1_100_000}}))
    (tmp_path / "proj" / "subagents").mkdir()
    (tmp_path / "proj" / "subagents" / "b.jsonl").write_text(json.dumps(rec))
    lines = jsonl.discover(spark, str(tmp_path), "claude")
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [0, 1, 2, 3, 4]
    recs = jsonl.message_records(lines).orderBy("line_no").collect()
    assert [r.line_no for r in recs] == [0, 3, 4]
    assert recs[0].message.content[0].text == "hello" and recs[1].message.content[0].name == "Read" and json.loads(recs[1].message.content[0].input) == {"file": "x"}
    assert recs[1].message.usage.input_tokens == 3 and len(recs[2].message.content[0].text) == 1_100_000
    assert jsonl.mining_corpus(spark, str(tmp_path)).select("file").distinct().count() == 1
    index = lines.select("agent", "file", "file_size", "modified_at").distinct()
    assert jsonl.new_files(index, index).count() == 0


def test_forked_sessions_keep_only_their_own_usage(spark):
    lines = envelope(("session_meta", {"id": "x", "forked_from_id": "y"}), usage(310, 41), usage(777, 95), ("turn_context", {"model": "gpt-4.1-mini"}), usage(790, 131, 0, 17))
    rows = normalize.forward_fill_model(normalize.envelopes(lines_df(spark, lines)))
    d = normalize.usage_deltas(rows).collect()
    assert [(r.input_tokens, r.output_tokens, r.cache_creation_input_tokens, r.cache_read_input_tokens) for r in d] == [(13, 36, 0, 17)]
    assert {r.model for r in rows.collect()} == {"gpt-4.1-mini"}


def test_interleaved_calls(spark):
    call = lambda i, cmd: ("response_item", {"type": "function_call", "name": "exec", "call_id": i, "arguments": json.dumps({"cmd": cmd})})
    out = lambda i, text: ("response_item", {"type": "function_call_output", "call_id": i, "output": text})
    lines = envelope(call("A", "rm x"), call("B", "ls"), out("B", "permission denied"), out("A", "permission denied"), out("A", "late"), call(None, "mv a b"), out(None, "fine"), out(None, "odd"))
    p = {r.i: r for r in normalize.output_errors(normalize.call_pairs(normalize.envelopes(lines_df(spark, lines)))).collect()}
    assert (p[2].call_i, p[2].error_summary) == (1, None) and (p[3].call_i, p[3].error_summary) == (0, "permission denied")
    assert p[4].call_i is None and p[6].call_i == 5 and p[7].call_i is None


def test_split_messages_and_replays(spark, make_records):
    from tests.conftest import block, record
    from threadloom.operators.ordered import canonical

    rows = [
        record(1, index=0, type="assistant", message_id="m", blocks=[block(text="a")], model=None), record(2, index=1, type="assistant", message_id="m", blocks=[block(text="a"), block(text="b")], model="x", usage=(1, 2, 3, 4)),
        record(3, index=2, text="hi"), record(4, index=3, uuid="u3", text="hi"), record(5, index=4, replay=True, text="old"),
    ]
    df = make_records(rows)
    assert {r.rec_id for r in normalize.replay_dedup(df).collect()} == {1, 2, 3}
    m = {r.i: r for r in normalize.merge_split_messages(canonical(df)).collect()}
    assert m[0].n_rows == 2 and m[0].model == "x" and m[0].usage.output_tokens == 2 and [json.loads(b)["text"] for b in m[0].blocks_json] == ["a", "b"]


def test_normalized_numbers_kept_rows(spark):
    lines = envelope(("session_meta", {"id": "x"}), ("response_item", {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}]}), ("event_msg", {"type": "turn_aborted"}), ("event_msg", {"type": "task_complete"}))
    got = [(r.i, r.kind, r.text) for r in normalize.normalized(lines_df(spark, [*lines, "", "{bad"])).orderBy("i").collect()]
    assert got == [(0, "user", "hi"), (1, "interrupt", None)]


def test_stream_equals_batch(spark, tmp_path):
    t = lambda h: datetime(2026, 1, 1, h)
    rows = [(1, t(0)), (1, t(1)), (1, t(9)), (2, t(2)), (1, t(23))]
    src = spark.createDataFrame(rows, "user_id int, ts timestamp")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = {tuple(r) for r in streams.session_gaps(src, "user_id", "ts", "2 hours").collect()}
    s = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    streams.run_available(streams.session_gaps(s, "user_id", "ts", "2 hours"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r for r in batch if r[1] < t(22)}  # the last one waits for the watermark
    d = streams.deduplicated(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), "user_id", "ts", "2 days")
    streams.run_available(d, f"{tmp_path}/out2", f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/out2").count() == 2


def test_lines_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text('{"a":1}\n{"a":2}\n')
    s = streams.line_stream(spark, f"{tmp_path}/in").select(F.get_json_object("raw", "$.a").alias("a"))
    streams.run_available(s, f"{tmp_path}/o", f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/o").count() == 2


def test_three_dialects_under_one_schema(spark, tmp_path):
    from threadloom.operators import stats
    from threadloom.operators.ordered import canonical

    msg = lambda t, text, **kw: json.dumps({"type": t, "timestamp": "2026-01-01T10:00:00Z", "message": {"role": t, "content": text} | kw.pop("m", {})} | kw)
    for path, lines in {
        "claude/proj/a.jsonl": [msg("user", "hi", uuid="u1", cwd="/work/my-app"), "{broken", msg("assistant", [{"type": "text", "text": "yes"}, {"type": "tool_use", "name": "Bash", "id": "c", "input": {"command": "ls"}}], uuid="u2", m={"model": "m"})],
        "codex/deep/er/b.jsonl": envelope(("turn_context", {"model": "g"}), ("response_item", {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}), usage(5, 7), ("response_item", {"type": "function_call", "name": "exec", "arguments": "{\"cmd\": \"rm x\"}"}), ("response_item", {"type": "function_call_output", "output": "permission denied"})),
        "cowork/ws/local_1/audit.jsonl": [msg("user", "old", isReplay=True), msg("user", "new", uuid="n"), msg("user", "new", uuid="n"), msg("assistant", [{"type": "text", "text": "a"}], uuid="x", m={"id": "M"}), msg("assistant", [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], uuid="y", m={"id": "M", "model": "q"})],
        "cowork/ws/local_1.json": [json.dumps({"title": "T", "createdAt": 1767000000000, "lastActivityAt": 1767000100000})], "cowork/ws/other/audit.jsonl": [msg("user", "no")],
    }.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("\n".join(lines))
    lines = jsonl.discover_all(spark, f"{tmp_path}/claude", [f"{tmp_path}/codex", f"{tmp_path}/nowhere"], f"{tmp_path}/cowork")
    rows = jsonl.read_records(lines)
    got = {(r.agent, r.i): (r.type, r.text, r.model, [b.type for b in r.blocks]) for r in rows.collect()}
    assert got == {
        ("claude", 0): ("user", "hi", None, ["text"]), ("claude", 1): ("assistant", "yes", "m", ["text", "tool_use"]),
        ("codex", 0): ("user", "do it", None, ["text"]), ("codex", 1): ("system", "", "g", []), ("codex", 2): ("assistant", "", "g", ["tool_use"]), ("codex", 3): ("user", "", None, ["tool_result"]),
        ("cowork", 0): ("user", "new", None, ["text"]), ("cowork", 1): ("assistant", "a\nb", "q", ["text", "text"]),
    }
    assert stats.turn_stats(rows).count() == 3 and stats.usage_share(rows).where("tokens > 0").first().tokens == 12
    assert rows.where("agent = 'codex' and size(blocks) > 0 and blocks[0].is_error").count() == 1
    files = lines.select(jsonl.session_of(F.col("file")).alias("session_id"), "file", "agent", F.col("file_size").alias("size_bytes"), "modified_at").distinct()
    side = jsonl.side_times(lines, jsonl.side_metadata(spark, f"{tmp_path}/cowork"))
    cat = {r.agent: r for r in stats.catalogue(rows, files, side).collect()}
    assert (cat["claude"].project_name, cat["claude"].prompt_count, cat["claude"].record_count) == ("My App", 1, 2) and cat["cowork"].project_name == "Cowork"
    assert cat["cowork"].started_at.timestamp() == 1767000000 and cat["codex"].agent_name == "Codex"
    assert jsonl.corpus_size(lines).first().files == 3 and {r.lines for r in jsonl.fold_files(lines).collect()} == {2, 5}
    assert stats.selected(stats.catalogue(rows, files), [cat["claude"].project_id], "2026-01-01", "2026-01-01").count() == 1


def test_stores(spark, tmp_path):
    from threadloom.sources import store

    root, schema = f"file://{tmp_path}/reports", "id string, createdAt string, n int"
    assert store.list_reports(spark, root, schema).count() == 0
    row = lambda i, at, n: spark.createDataFrame([(i, at, n)], schema)
    store.save_report(row("report-1", "2026-01-01", 1), root, "report-1")
    store.save_report(row("report-2", "2026-01-02", 2), root, "report-2")
    assert [r.n for r in store.list_reports(spark, root, schema).collect()] == [2, 1] and store.load_report(spark, root, "report-1", schema).first().n == 1
    import pytest

    with pytest.raises(Exception):
        store.save_report(row("report-1", "x", 3), root, "report-1")
    with pytest.raises(ValueError):
        store.save_report(row("../x", "x", 3), root, "../x")
    at, ix = f"file://{tmp_path}/index", "agent string, file string, file_size long, modified_at int"
    index = lambda *r: spark.createDataFrame(list(r), ix)
    assert store.read_index(spark, at, ix).count() == 0
    store.write_index(index(("a", "f", 1, 1), ("a", "g", 1, 1)), at)
    fresh = jsonl.merge_index(store.read_index(spark, at, ix), index(("a", "f", 2, 2)))
    store.write_index(fresh, at)
    assert sorted(map(tuple, store.read_index(spark, at, ix).collect())) == [("a", "f", 2, 2), ("a", "g", 1, 1)]
    assert jsonl.new_files(index(("a", "f", 2, 2), ("a", "g", 5, 1)), store.read_index(spark, at, ix)).count() == 1
