"""Chunked windows equal plain ones, whatever the chunk size."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators import detectors
from threadloom.operators.ordered import canonical, frame, ranked, running, with_halo
from tests.conftest import block, record


def _rows(spark, n=500):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.8 else f"s{rnd.randrange(9)}", rnd.choice([None, rnd.randrange(300)]), k, None, rnd.randrange(5), rnd.choice([None, k])) for k in range(n)]
    return spark.createDataFrame(rows, "session_id string, record_index long, rec_id long, ts timestamp, v int, w long")


def test_rank_and_running_sums(spark):
    rows = _rows(spark)
    plain = Window.partitionBy("session_id").orderBy(F.col("record_index").asc_nulls_last(), F.col("ts").asc_nulls_last(), "rec_id")
    want = rows.withColumn("i", F.row_number().over(plain) - 1)
    for chunk in (3, 64, 4096):
        got = ranked(rows, chunk)
        assert {(r.rec_id, r.i) for r in got.collect()} == {(r.rec_id, r.i) for r in want.collect()}
        got = running(got, sums={"s": F.col("v")}, lasts={"l": F.col("w")}, chunk=chunk)
        full = plain.rowsBetween(Window.unboundedPreceding, 0)
        exp = rows.withColumn("s", F.sum("v").over(full)).withColumn("l", F.last("w", True).over(full))
        assert {(r.rec_id, r.s, r.l) for r in got.collect()} == {(r.rec_id, r.s, r.l) for r in exp.collect()}


def test_halo_frames(spark):
    rows = ranked(_rows(spark))
    w = Window.partitionBy("session_id").orderBy("i").rowsBetween(-3, 2)
    want = {(r.rec_id, tuple(r.x)) for r in rows.withColumn("x", F.collect_list("v").over(w)).collect()}
    for chunk in (4, 7, 4096):
        h = with_halo(rows, 3, 2, chunk).withColumn("x", F.collect_list("v").over(frame(-3, 2))).where("own")
        assert {(r.rec_id, tuple(r.x)) for r in h.collect()} == want


def test_findings_do_not_depend_on_chunks(spark, data):
    from threadloom.session import read_table

    rows = canonical(read_table(spark, data, "records")).cache()
    key = lambda df: sorted((r.session_id, r.i, r.kind, r.score) for r in df.collect())
    assert key(detectors.detect(rows, 8)) == key(detectors.detect(rows))


def test_repetition_and_verification(make_records):
    use = lambda name: [block("tool_use", id="c", name=name, input="{}")]
    rows = [
        record(1, index=0, type="assistant", blocks=use("exec_command")),
        record(2, index=1, type="user", blocks=[block("tool_result", tool_use_id="c", content="boom", is_error=True)]),
        record(3, index=2, type="assistant", blocks=use("exec_command")),
        record(4, index=3, type="assistant", text="All set, it is fixed."),
        record(5, index=4, type="user", text="no, that's wrong"),
        record(6, index=5, type="assistant", text="Sorry, you're right."),
        record(7, index=6, type="user", text="Delete everything"),
        record(8, index=7, type="assistant", text="Which files exactly?"),
    ]
    got = {(r.i, r.kind, r.score) for r in detectors.detect(canonical(make_records(rows))).collect()}
    assert got == {(1, "repetition", 0.66), (3, "verification", 0.72), (4, "correction", 0.81), (6, "clarification", 0.76)}


def test_scratch_tables_go(spark):
    import os

    from threadloom.session import materialize, scratch

    with scratch():
        df = materialize(spark.range(3), "x")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
