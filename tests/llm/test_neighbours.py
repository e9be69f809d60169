import numpy as np
from pyspark.sql import functions as F

from tessera.llm import neighbours as N


def brute(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 100 == 0:
            d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i and len(v) == len(q))
            out[i] = d[:k]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, id int").repartition(3)
    out = {}
    for r in sorted(N.nearest(df, F.pmod("id", F.lit(100)) == 0).collect()):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + rng.normal(size=24)]) for i in range(3000)]
    want, got = brute(rows), run(spark, rows)
    assert set(want) == set(got)
    hits = sum(len({j for _, j in want[q]} & {j for _, j in got[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    exact = dict(rows)
    for q, found in got.items():
        assert found == sorted(found)
        for d, j in found:
            assert abs(d - np.sqrt(((np.array(exact[q]) - np.array(exact[j])) ** 2).sum())) < 1e-12


def test_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(400, None), (500, [0.0, 0.0]), (600, [1.0, float("nan")]), (700, [float("inf"), 1.0]), (800, [1.0, None]), (900, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    got = run(spark, rows)
    assert got[0] == [(0.0, i) for i in range(1, 11)]
    assert got[200] == [(0.0, i) for i in range(10)]
    assert set(got) == {0, 100, 200}


def test_few_and_none(spark):
    assert run(spark, [(100, [1.0]), (1, [3.0])]) == {100: [(2.0, 1)]}
    assert run(spark, []) == {}


def test_chi_square():
    assert abs(N.chi_square_quantile(0.95, 8) - 15.5073) < 1e-3


def test_many_cells_pieces_and_parts(spark, monkeypatch):
    """A hot vector fills cells of its own, and queries go to other cells than their own."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in (rng.normal(size=12) if i % 3 else np.full(12, 0.5))]) for i in range(4000)]
    monkeypatch.setattr(N, "BLOCK", 100)
    monkeypatch.setattr(N, "PART", 2)
    want, got = brute(rows), run(spark, rows)
    assert set(want) == set(got)
    hits = sum(len({j for _, j in want[q]} & {j for _, j in got[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    assert got[300] == [(0.0, j) for j in range(0, 30, 3)]  # copies of the query: the smallest ids


def test_top_tree_routes_every_point():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5000, N.DIMS))
    cells = N.TopTree.fit(x[:1000], 4).cells(x)
    assert set(cells) == set(range(16)) and np.bincount(cells).max() < 1000
    assert (N.TopTree.fit(np.ones((50, N.DIMS)), 3).cells(np.ones((9, N.DIMS))) == N.TopTree.fit(np.ones((50, N.DIMS)), 3).cells(np.ones((1, N.DIMS)))).all()
    assert (N.TopTree.fit(x[:0], 0).cells(x) == 0).all()
