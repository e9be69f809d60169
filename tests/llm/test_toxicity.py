import random
import zlib

import numpy as np

from tessera.llm import toxicity as X


def corpus(n=700):
    r = random.Random(11)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        bad = r.random() < 0.2
        t = [r.choice(plain) for _ in range(r.randint(5, 60))]
        for _ in range(r.randint(1, 3) if bad else 0):
            t.insert(r.randrange(len(t)), r.choice(["vile", "Nasty", "awful"]))
        rows.append((i, " ".join(t), int(bad)))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(9000, None, 1), (9001, "", 1), (None, "vile vile", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (4, None)], "doc_id long, toxic int")
    model = X.fit_features(*X.training_features(docs, labels, X.is_training()))
    got = {r.id: r.score for r in X.score_texts(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.97
    assert got[9000] == got[9001] < 0.5 < got[None]


def test_no_positives(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit_features(*X.training_features(docs, labels, X.is_training()))
    assert [r.score for r in X.score_texts(docs, model).collect()] == [0.5]
    assert X.score_texts(docs.limit(0), model).count() == 0


def test_end_of_a_very_long_text_counts():
    model = X.Model(np.zeros(1 << X.BITS, np.float32), -3.0)
    raw = np.frombuffer(b"vile", np.uint8)
    f, _ = X.features(raw, np.array([0, 4]))
    model.weight[f] = 9
    long = np.frombuffer(b"filler text " * 100_000 + b"Vile", np.uint8)
    f, first = X.features(long, np.array([0, len(long)]))
    assert X._sums(model.weight[f], first)[0] == 9


def test_rare_words_of_few_positives_have_weights():
    r = random.Random(5)
    plain = [f"word{i}" for i in range(40)]
    make = lambda *more: " ".join([r.choice(plain) for _ in range(30)] + list(more)).encode()
    rare = ["vile", "nasty", "awful", "horrid"]
    positive = [make(rare[i % 4], rare[(i + 1) % 4]) for i in range(10)]
    model = X.fit(positive, positive + [make() for _ in range(60)], 0.15)
    assert model.weight.any()  # not the zero model

    def score(text):
        raw = np.frombuffer(text, np.uint8)
        f, first = X.features(raw, np.array([0, len(raw)]))
        return X._sums(model.weight[f], first)[0]

    assert all(score(w.encode()) > 0 for w in rare)
    assert min(score(make(*rare[:2])) for _ in range(20)) > max(score(make()) for _ in range(20))


def test_risk_and_slopes_against_plain_loops():
    rng = np.random.default_rng(8)
    zp, zu = rng.normal(size=7), rng.normal(size=11)
    loss = lambda z: np.log(1 + np.exp(-z))
    for shift in (0.0, -6.0):  # the corrected term is positive, then negative
        u, prior = zu + shift, 0.4
        first = prior * sum(loss(z) for z in zp) / 7
        second = sum(loss(-z) for z in u) / 11 - prior * sum(loss(-z) for z in zp) / 7
        assert np.allclose(X.risk(zp, u, prior), (first, second)) and (second >= 0) == (shift == 0)
        descended = (lambda p, u: sum(X.risk(p, u, prior))) if second >= 0 else (lambda p, u: -X.risk(p, u, prior)[1])
        got, step = X.slopes(zp, u, prior), 1e-6
        for part, z in enumerate((zp, u)):
            for i in range(len(z)):
                moved = z.copy()
                moved[i] += step
                after = descended(moved, u) if part == 0 else descended(zp, moved)
                assert abs((after - descended(zp, u)) / step - got[part][i]) < 1e-5


def test_long_and_repeated_texts_take_part_in_fitting(spark):
    docs = spark.createDataFrame([(i, "plain words only " * 20_000 + ("vile" if i % 2 else "kind"), 0) for i in range(1, 30)] + [(1, "twice", 0)], "doc_id long, text string, p int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    p, u, fold_p, fold_u, prior = X.training_features(docs, labels, X.is_training())
    inside = [i for i in range(1, 30) if zlib.crc32(str(i).encode()) % 5]
    assert len(p) == len(fold_p) == sum(i % 2 for i in inside) and len(u) == len(fold_u) == len(inside)
    assert all(len(x) in (1, 4) for x in u)


def test_held_out_ranking_on_the_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = X.fit_features(*X.training_features(docs, labels, X.is_training()))
    assert (model.weight != 0).sum() > 1000
    score = {r.id: r.score for r in X.score_texts(docs, model).collect()}
    held = [(score[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.toxic is not None and r.doc_id in score]
    good, bad = [s for s, y in held if y == 0], [s for s, y in held if y == 1]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.9


def test_sums_of_runs_against_plain_loops():
    rng = np.random.default_rng(3)
    values = rng.normal(size=40).astype(np.float32)
    first = np.concatenate([[0, 0], np.sort(rng.integers(0, 41, 12)), [40, 40]])
    assert np.allclose(X._sums(values, first), [sum(values[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)])
    assert X._sums(values[:0], np.array([0, 0, 0])).tolist() == [0.0, 0.0]
