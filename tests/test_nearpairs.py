"""Near duplicates by distance against all pairs, and what they write on the way."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import nearpairs, phrases


def brute(v):
    """Every two variants, as SQL defines a near duplicate without caps."""
    shingles = lambda t: set(t) if len(t) <= 3 else set(zip(t, t[1:]))
    out = set()
    for left, a, seen_a in v:
        for right, b, seen_b in v:
            short, long = sorted((len(a), len(b)))
            if seen_a < seen_b and short / long >= 0.65 and len(shingles(a) & shingles(b)) >= (1 if short <= 4 else 2):
                d = phrases._distance(a, b)
                if d <= int(long * (1 - (2 / 3 if long <= 3 else 0.7 if long <= 5 else 0.74)) + 1e-9):
                    out.add((left, right, round(1 - d / long, 6)))
    return out


def made(seed, n, words):
    """Distinct token lists of 1 to 30, many of them edited copies of others, with words that come again."""
    rnd = random.Random(seed)
    seen = []
    while len(seen) < n:
        t = list(rnd.choice(seen)) if seen and rnd.random() < 0.8 else [rnd.choice(words) for _ in range(rnd.choice((1, 2, 3, 4, 5, 6, 8, 12, 16, 22, 29)))]
        for _ in range(rnd.randint(0, 1 + len(t) // 4)):
            at = rnd.randrange(len(t))
            t[at : at + rnd.randint(0, 1)] = [rnd.choice(words)] * rnd.randint(0, 1)
            t = t or [words[0]]
        if t not in seen and len(t) <= 30:
            seen.append(t)
    return [(f"v{k}", t, f"{rnd.randrange(10**9):09d}/{k}") for k, t in enumerate(seen)]


def found(spark, v, part=None):
    df = spark.createDataFrame(v, "variant_id string, tokens array<string>, seen_at string")
    rows = (phrases.similar_pairs(df, None, None) if part is None else nearpairs.similar(df, part).selectExpr("left_id", "right_id", "round(1 - d / longest, 6) as similarity")).collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return set(map(tuple, rows))


def test_all_pairs_against_brute_force(spark):
    for seed, words in ((1, "abcdefgh"), (2, "ab"), (3, [f"w{k}" for k in range(60)])):
        v = made(seed, 220, list(words))
        want = brute(v)
        assert len(want) > 100 and found(spark, v) == want


def test_keys_in_parts_give_the_same(spark):
    v = made(4, 200, list("abcdef"))
    assert found(spark, v, 7) == found(spark, v, 64) == brute(v)


def _shuffled(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_of_common_shingles_are_not_shuffled(spark):
    """600 clauses with one beginning share two shingles each with all others: 179,700 pairs, none alike."""
    v = [(f"v{k}", ["as", "we", "agreed", *(f"w{k}x{j}" for j in range(9))], f"{k:05d}") for k in range(600)]
    before = _shuffled(spark)
    assert found(spark, v) == set()
    assert _shuffled(spark) - before < 20 * len(v)


def test_few_pairs_need_the_full_distance(monkeypatch):
    """400 clauses of one form with two words of their own: 79,800 pairs, whose distance place by place is the least one."""
    rows = [("0 as", "\0\0\0", f"v{k}", k, nearpairs.SEP.join(["as", f"a{k % 20}", "agreed", "we", "ship", f"b{k // 20}", "on", "the", "next", "free", "day"])) for k in range(400)]
    table = pa.Table.from_pylist([dict(zip(nearpairs._COLUMNS, r)) for r in rows])
    full, plain = [], nearpairs._distances
    monkeypatch.setattr(nearpairs, "_distances", lambda a, b, *rest: full.append(b.shape[1]) or plain(a, b, *rest))
    made_ = [x for left, right, d in nearpairs._Group(table).similar() for x in zip(left.tolist(), right.tolist(), d.tolist())]
    assert len(made_) == len({x[:2] for x in made_}) == 400 * 399 // 2
    assert all(d == (left % 20 != right % 20) + (left // 20 != right // 20) for left, right, d in made_)
    assert sum(full) < 100


def test_distances_within_the_band():
    rnd = random.Random(5)
    for _ in range(300):
        n, g = rnd.randint(4, 30), rnd.randint(0, 2)
        k = max(nearpairs.most_edits(n), g)
        a, b = ([rnd.choice("abc") for _ in range(m)] for m in (n - g, n))
        if rnd.random() < 0.7:
            gone = set(rnd.sample(range(n), g))
            a = [x for p, x in enumerate(b) if p not in gone]
            p, q = rnd.randrange(n - g), rnd.randrange(n - g)
            a.insert(q, a.pop(p))
        d = nearpairs._distances(*(np.array([[ord(c)] for c in x] + [[-1]] * (n - len(x))) for x in (a, b)), np.array([n]), g, k)[0]
        want = phrases._distance(a, b)
        assert d == want if want <= k else d > k


def test_sequences_are_the_variants_in_their_order(spark):
    from threadloom.plans import catalog

    at = "/root/testdata/sf0.001"
    key = lambda r: (r.variant_id, tuple(r.tokens))
    want = [key(r) for r in sorted(phrases.variants(catalog._rows(spark, at)).collect(), key=lambda r: r.seen_at)]
    assert want and [key(r) for r in sorted(phrases.sequences(catalog._plain(spark, at)).collect(), key=lambda r: r.seen_at)] == want


def test_tokens_of_clauses_are_made_once(spark):
    from threadloom.plans import catalog

    plan = phrases.family_units(catalog._plain(spark, "/root/testdata/sf0.001").withColumn("i", F.col("rec_id")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("(?s)```.*?```") == 1


def test_class_of_compatible_letters_in_ranges():
    form = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), T._HOLDS_COMPATIBLE))
    assert {c for c in map(chr, range(0x80, 0x10000)) if form.match(c)} == set(T._COMPATIBLE)
    assert T._HOLDS_COMPATIBLE.count("{") < 2 * len(T._COMPATIBLE) // 3
