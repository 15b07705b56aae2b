from collections import Counter

import pytest

from threadloom.llm import terms
from threadloom.session import read_table


@pytest.mark.parametrize("limits", [{}, {"bits": 2, "max_bytes": 2000}, {"bits": 1, "max_bytes": 4000, "memory": "16MB", "spill": False}])
def test_counts_with_and_without_splitting(spark, data, limits):
    t = terms.block_texts(read_table(spark, data, "records"))
    seen, occ, rec, n = set(), Counter(), Counter(), 0
    for r in sorted(t.collect(), key=lambda r: r.rec_id):
        if r.uuid is not None and r.uuid in seen:
            continue
        seen.add(r.uuid)
        own = Counter(w for x in r.texts or [] if x for w in terms.TERM.findall(x.lower()))
        occ.update(own)
        rec.update(own.keys())
        n += bool(own)
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.term_frequencies(t, **limits).collect()}
    assert got == {w: (occ[w], rec[w], "rare" if rec[w] < 3 else "common" if rec[w] * 25 > n else "") for w in occ}


def test_dirty_texts(spark):
    rows = [(1, "a", ["Straße_x 1½ don't", None]), (2, "a", ["copy"]), (3, None, [""]), (4, None, None), (5, "b", ["日本 é́ x"])]
    df = spark.createDataFrame(rows, "rec_id long, uuid string, texts array<string>")
    got = {r.term: r.records for r in terms.term_frequencies(df).collect()}
    assert got == {"straße": 1, "x": 2, "1½": 1, "don": 1, "t": 1, "日本": 1, "é": 1}


def test_no_terms(spark):
    df = spark.createDataFrame([], "rec_id long, uuid string, texts array<string>")
    assert terms.term_frequencies(df).count() == 0


def test_splits_three_levels_deep(spark):
    df = spark.range(40_000).selectExpr("id as rec_id", "cast(null as string) as uuid", "array(concat('t', id), 'common') as texts")
    counts = df.select("texts").mapInArrow(terms._count, terms._COUNTS)
    levels = terms._leaves(counts, 6_000, 2, 0)
    assert len(levels) >= 3 and levels[-1].count() >= 32
    got = terms.term_counts(df, bits=2, max_bytes=6_000)
    assert got.count() == 40_002 and got.where("term = 'common'").first().records == 40_000 and got.where("term is null").first().records == 40_000


@pytest.mark.parametrize("spill", [True, False])
def test_leaf_larger_than_the_memory(tmp_path, spill):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 400_000
    for k in range(2):
        pq.write_table(pa.table({"term": [None, *(f"term number {i}" for i in range(n))], "occurrences": pa.array([1] * (n + 1), pa.int64()), "records": pa.array([1] * (n + 1), pa.int64())}), tmp_path / f"{k}.parquet")
    paths = [f"file://{tmp_path}/{k}.parquet" for k in range(2)]
    size = sum((tmp_path / f"{k}.parquet").stat().st_size for k in range(2))
    seen = Counter()
    for b in terms._sum_leaf(paths, size, str(tmp_path / "spill") if spill else "", "32MB"):
        seen.update(b.column("records").to_pylist())
    assert seen == {2: n + 1}
