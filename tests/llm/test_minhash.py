import random
import re

import numpy as np
import pytest

from tessera.llm import minhash as M
from tessera.llm.components import connected_components


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            (a, s), (b, t) = sets[i], sets[j]
            both = len(s & t)
            if both and 100 * both >= 75 * (len(s) + len(t) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def family(r, vocabulary, copies, length, change):
    base = [r.choice(vocabulary) for _ in range(length)]
    out = [base]
    for _ in range(copies):
        b = list(r.choice(out[-3:]))
        for _ in range(change):
            b[r.randrange(len(b))] = r.choice(vocabulary)
        out.append(b)
    return [" ".join(x) for x in out]


def test_against_brute_force(spark):
    r = random.Random(8)
    v = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):
        texts += family(r, v, r.randint(1, 8), r.randint(20, 160), r.randint(1, 4))
    texts += family(r, v, 60, 200, 4)  # a drifting chain: its ends are not alike
    texts += ["one two", "One  TWO", "one two three", None, "", " \t", "a b c d e"] + ["same text here for all of you"] * 20
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, n int").repartition(5)
    assert sorted(map(tuple, M.near_dedup(docs).collect())) == brute(rows)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_dedup(empty).count() == 0
    got = M.near_dedup(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True)]


@pytest.mark.parametrize("n", [2, 70])
def test_components_of_a_path(spark, n):
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = dict(map(tuple, connected_components(e).collect()))
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_pigeonhole_finds_every_close_signature():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 16, (2000, 32))
    b = a.copy()
    for row in b:
        row[r.choice(32, 15, replace=False)] ^= 1
    same = (a == b).reshape(2000, 8, 4).sum(axis=2)
    assert (same.max(axis=1) >= 3).all()


def test_departures_never_refuse_a_similar_pair(spark):
    r = random.Random(5)
    v = [f"w{i}" for i in range(500)]
    texts = [r.choice(v) for _ in range(150)]
    rows = [(0, " ".join(texts))]
    for i in range(1, 60):
        t = list(texts)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice(v)
        rows.append((i, " ".join(t[: r.randint(130, 150)])))
    docs = spark.createDataFrame(rows, "id long, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)], "a long, b long")
    hub = M.compared(docs, pairs)
    sets = {i: shingle_set(t) for i, t in rows}
    like = lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    assert all(x.link == like(0, x.b) for x in hub.collect())
    got = {(x[0], x[1]) for x in hub.alias("u").join(hub.alias("v"), M.F.expr("u.b < v.b")).where(M.may_link("u", "v")).select("u.b", "v.b").collect()}
    want = {(i, j) for i in range(1, 60) for j in range(i + 1, 60) if like(i, j)}
    assert want <= got and len(got) < len(want) + 200


def test_words_that_defeat_polynomial_hashes(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = spark.createDataFrame([(1, "p q r s " + one), (2, "p q r s " + two), (3, one), (4, two)], "doc_id long, text string")
    assert sorted(r.component_id for r in M.near_dedup(docs).collect()) == [1, 2, 3, 4]


def test_words_are_compared_where_hashes_agree():
    h = np.array([7, 9], np.uint64)
    assert M.same_words(b"a b c d e f", b"A b c d e  f", h, h)
    assert not M.same_words(b"a b c d e f", b"a b c d e g", h, h)


def test_stars_of_members_far_from_their_leader(spark):
    """Around one text many that are not similar to it, some of them close to each other, some to nobody."""
    r = random.Random(3)
    v = [f"w{i}" for i in range(5000)]
    base = [r.choice(v) for _ in range(120)]

    def changed(words, n):
        out = list(words)
        for i in r.sample(range(len(out)), n):
            out[i] = r.choice(v)
        return out

    texts = [base]
    for n in (4, 5, 6, 7):
        for _ in range(12):
            far = changed(base, n)
            texts.append(far)
            texts += [changed(far, r.randint(1, 3)) for _ in range(3)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, M.near_dedup(docs).collect())) == brute(rows)


def test_first_shared_key(spark):
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 16, (300, 32))
    b = np.where(r.random((300, 32)) < 0.4, a ^ 1, a)
    pack = lambda x: [[int(np.int64(np.uint64(sum(int(y[4 * c + k]) << (16 * k) for k in range(4))))) for c in range(8)] for y in x]
    side = lambda x: spark.createDataFrame([(i, *s) for i, s in enumerate(pack(x))], "i long, " + ", ".join(f"s{c} long" for c in range(8)))
    at = spark.range(32).select(M.F.col("id").cast("int").alias("at"))
    got = side(a).alias("u").join(side(b).alias("v"), "i").crossJoin(at).where(M.first_shared("u", "v", "at")).groupBy("i").agg(M.F.max("at")).collect()
    for i, last in got:
        shared = [4 * c + k for c in range(8) for k in range(4) if all(a[i, 4 * c + j] == b[i, 4 * c + j] for j in range(4) if j != k)]
        assert last == (shared[0] if shared else 31)


def around_a_passage(r, texts, own):
    """Texts that share one passage and little else, some of them with a close copy."""
    v = [f"w{i}" for i in range(5000)]
    passage = [r.choice(v) for _ in range(20)]
    out = [passage]
    while len(out) < texts:
        out.append(passage + [r.choice(v) for _ in range(r.randint(6, own))])
        if r.random() < 0.2:
            out.append([*out[-1], r.choice(v)])
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_members_of_wide_keys_meet_in_blocks(spark, monkeypatch):
    """Of the pairs around one passage few are left to compare, though the join's own test refuses none here."""
    rows = around_a_passage(random.Random(6), 300, 12)
    seen, compared = [], M.compared

    def counted(texts, pairs):
        seen.append(pairs.count())
        return compared(texts, pairs)

    monkeypatch.setattr(M, "compared", counted)
    monkeypatch.setattr(M, "may_link", lambda u, v: M.F.lit(True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, M.near_dedup(docs).collect())) == brute(rows)
    assert sum(seen) < 20 * len(rows)


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "WIDE", 3)
    monkeypatch.setattr(M, "BLOCK", 7)
    r = random.Random(7)
    texts = [t for _, t in around_a_passage(r, 80, 30)]
    v = [f"v{i}" for i in range(3000)]
    base = [r.choice(v) for _ in range(120)]
    for n in (4, 5, 6, 7):
        for _ in range(8):
            far = list(base)
            for i in r.sample(range(120), n):
                far[i] = r.choice(v)
            texts += [" ".join(far), " ".join([*far, r.choice(v)])]
    rows = [(f"id{i}", t) for i, t in enumerate([" ".join(base), *texts])]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    assert sorted(map(tuple, M.near_dedup(docs).collect())) == brute(rows)


def test_blocks_refuse_what_the_join_refuses(spark):
    r = np.random.default_rng(9)
    rows = []
    for i in range(90):
        gone, new = r.integers(0, 1 << 62, 8) & r.integers(0, 1 << 62, 8) & r.integers(0, 1 << 62, 8), r.integers(0, 1 << 62, 8) & r.integers(0, 1 << 62, 8)
        rows.append((i, i % 40, 400, int(r.integers(380, 500)), int(r.integers(150, 260)), *map(int, gone), *map(int, new)))
    names = ["cid", "comp", "na", "nb", "n_new", *M._GONE, *M._NEW]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    u, v = frame.where("cid < 70").alias("u"), frame.where("cid >= 20").alias("v")
    want = {tuple(x) for x in u.join(v, M.may_link("u", "v") & M.F.expr("u.comp <> v.comp")).select("u.cid", "v.cid").collect()}
    block = M.pa.array([dict(zip(names, x, strict=True)) for x in rows])
    a, b = M.unrefused(block[:70], block[20:])
    assert {(i, j + 20) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == want
    assert 100 < len(want) < 3000
