import math
import random

from tessera.llm import mixing as M


def docs(spark, sizes, seed=0):
    r = random.Random(seed)
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join("w" * r.randint(1, 4) for _ in range(r.randint(1, 40))), s, -1))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight int").repartition(4), rows


def shares(rows, a=1.0):
    t = {}
    for _, text, s, _ in rows:
        t[s] = t.get(s, 0) + len(text.split())
    n = sum(t.values())
    q = {s: (v / n) ** a for s, v in t.items()}
    return t, {s: v / sum(q.values()) for s, v in q.items()}


def entropy(p):
    return -sum(x * math.log(x) for x in p.values() if x)


def test_weights_copies_and_budget(spark):
    df, rows = docs(spark, {"big": 3000, "mid": 600, "small": 150, None: 90})
    got = M.mix(df, evenness=0.7, repeats=100).collect()
    t, p = shares(rows)
    weights = {r.source: r.weight for r in got}
    assert len(got) == len(rows) and abs(sum(weights.values()) - 1) < 1e-9
    assert abs(entropy(weights) - 0.7 * math.log(4)) < 1e-4
    longest = 40
    for s, w in weights.items():
        taken = sum(r.copies * r.n_tokens for r in got if r.source == s)
        assert w * sum(t.values()) - longest <= taken <= w * sum(t.values()) + 1
        assert max(r.copies for r in got if r.source == s) - min(r.copies for r in got if r.source == s) <= 1


def test_repetition_limit_wins(spark):
    df, rows = docs(spark, {"big": 2000, "small": 20})
    got = M.mix(df, evenness=1.0, repeats=2.0).collect()
    t, _ = shares(rows)
    w = {r.source: r.weight for r in got}
    assert abs(w["small"] * sum(t.values()) / t["small"] - 2.0) < 1e-3
    # brute bisection of the exponent
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if shares(rows, mid)[1]["small"] * sum(t.values()) / t["small"] > 2 else (lo, mid)
    assert abs(shares(rows, hi)[1]["small"] - w["small"]) < 1e-6


def test_blocks_follow_the_fixed_order(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 64)
    df, rows = docs(spark, {"big": 1500, "small": 100}, seed=4)
    got = M.mix(df, evenness=0.8, repeats=50, budget=0.5 * sum(shares(rows)[0].values())).collect()
    again = M.mix(df.repartition(7), evenness=0.8, repeats=50, budget=0.5 * sum(shares(rows)[0].values())).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    big = [r for r in got if r.source == "big"]
    partly = [b for b in {r.block for r in big} if len({r.copies for r in big if r.block == b}) > 1]
    assert len({r.block for r in big}) > 10 and len(partly) <= 1
    for b in partly:
        flags = [r.copies for r in sorted((r for r in big if r.block == b), key=lambda r: (r.place, r.doc_id))]
        assert flags == sorted(flags, reverse=True)


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(empty).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, "", "a"), (None, " ", "a")], "doc_id long, text string, source string")
    assert [r.copies for r in M.mix(odd).collect()] == [1, 1, 1]
    one = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x")], "doc_id long, text string, source string")
    assert [r.copies for r in M.mix(one).collect()] == [1, 1]


def test_copies_against_a_replayed_order(spark, monkeypatch):
    """Given the weights, a plain walk over each source's order takes the same rows; long, null and repeated texts too."""
    monkeypatch.setattr(M, "BLOCK", 32)
    df, rows = docs(spark, {"big": 900, "small": 80}, seed=9)
    more = [(5000, "word " * 30_000, "big", 0), (5001, None, "big", 0), (5002, "a b", "small", 0), (5002, "a b", "small", 0)]
    df = df.unionByName(spark.createDataFrame(more, df.schema))
    got = M.mix(df, evenness=0.9, repeats=50).collect()
    total = sum(r.n_tokens for r in got)
    for source in ("big", "small"):
        own = sorted((r for r in got if r.source == source), key=lambda r: (r.block_rank, r.place, r.doc_id, r.n_tokens))
        tokens = sum(r.n_tokens for r in own)
        passes = total * own[0].weight / tokens
        full, walked = math.floor(passes + 1e-9), 0
        for r in own:
            assert r.begin == walked
            walked += r.n_tokens
            assert r.copies == full + int(walked <= (passes - full) * tokens + 1e-6)
