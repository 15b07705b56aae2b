import random

from threadloom.llm import packing, tokens


def test_ids_offsets_and_round_trip(spark):
    texts = [None, "", " ", "plain words", "<|endoftext|>", "naïve 日本語 🚀👩🏽‍💻 ‮", "a\x00b\r\n", "x" * 70_000, "é" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", tokens_lit())
    enc = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert enc[0] == enc[1] == [] and 50256 not in enc[4]
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    for r in tokens.encode_with_offsets(df).collect():
        t = texts[r.doc_id] or ""
        assert [x.id for x in r.tokens] == enc[r.doc_id]
        assert all(0 <= x.char_start < x.char_end <= len(t) for x in r.tokens)
        if t:
            assert r.tokens[0].char_start == 0 and r.tokens[-1].char_end == len(t)
            assert all(b.char_start <= a.char_end for a, b in zip(r.tokens, r.tokens[1:]))


def tokens_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_decoding_of_cut_and_unknown_ids(spark):
    ids = spark.createDataFrame([(1, [27332]), (2, None), (3, [99_999_999])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in tokens.decode(ids).collect()}
    assert got[2] is None and got[3] is None and got[1] is not None


def test_packing_fills_and_splits_only_large_items(spark):
    rnd = random.Random(5)
    items = [(k, rnd.choice([0, rnd.randint(1, 90), rnd.randint(50, 300)])) for k in range(3000)] + [(9999, 1001)]
    sizes = spark.createDataFrame(items, "doc_id long, n_tokens long")
    kinds = spark.createDataFrame([("a", 200), ("b", 1000), ("none", None)], "container_kind string, capacity_tokens long")
    packed = packing.pack(sizes, kinds, open_windows=16, per_partition=300).collect()
    for kind, cap in (("a", 200), ("b", 1000)):
        own = [r for r in packed if r.container_kind == kind]
        used, total = {}, {}
        for r in own:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
            total.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        assert max(used.values()) <= cap
        for d, n in items:
            parts = sorted(total.get(d, []))
            assert sum(x for _, x in parts) == n and len(parts) == -(-n // cap)
            assert all(a + x == b for (a, x), (b, _) in zip(parts, parts[1:]))
        assert sum(used.values()) / (len(used) * cap) > (0.93 if kind == "a" else 0.97)
    report = {r.container_kind: r for r in packing.fill_report(packing.pack(sizes, kinds)).collect()}
    assert report["b"].n_containers >= report["b"].volume_bound


def test_merging_tree_is_whole(spark):
    rnd = random.Random(9)
    items = [(k, rnd.randint(60, 130)) for k in range(4000)] + [(10_000, 100_003)]
    sizes = spark.createDataFrame(items, "doc_id long, n_tokens long")
    kinds = spark.createDataFrame([("a", 200)], "container_kind string, capacity_tokens long")
    packed = packing.pack(sizes, kinds, open_windows=8, per_partition=100, fan_in=4)
    bad = packing.invariants(packed, sizes, kinds).first()
    assert tuple(bad)[1:] == (0, 0, 0, 0)
    broken = packing.invariants(packed.where("doc_id <> 7").withColumn("n_tokens", packed.n_tokens + 150), sizes, kinds).first()
    assert broken.overfull > 0 and broken.misplaced > 0 and broken.missing == 1
    assert packing.fill_report(packed).first().fill > 0.9


def test_packing_nothing(spark):
    sizes = spark.createDataFrame([], "doc_id long, n_tokens long")
    kinds = spark.createDataFrame([("a", 5)], "container_kind string, capacity_tokens long")
    assert packing.pack(sizes, kinds).count() == 0
