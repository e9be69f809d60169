import random
import zlib

import numpy as np

from tessera.llm import quality as Q


def corpus(n, seed=3):
    r = random.Random(seed)
    good = ["the river ran past old stone houses", "we walked home along the quiet road", "she wrote a long letter to her friend"]
    bad = ["buy buy buy cheap", "click here | win | now", "aaaa bbbb | aaaa"]
    rows = []
    for i in range(n):
        y = int(r.random() < 0.6)
        rows.append((i, " ".join(r.choice(good if y else bad) for _ in range(r.randint(2, 12))), y))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, None), (901, "", None), (None, "click here", None)], "doc_id long, text string, id string")
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(None, 1, None), (3, None, 1)], "doc_id long, quality int, text int")
    model = Q.train_quality(docs, labels, Q.is_training())
    got = {r.id: r.score for r in Q.score_texts(docs, model).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(held) > 0.95
    assert got[900] == got[901]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.train_quality(docs, labels, Q.is_training())
    assert [r.score for r in Q.score_texts(docs, model).collect()] == [0.5]
    assert Q.score_texts(docs.limit(0), model).count() == 0


def test_whole_text_counts(spark):
    model = Q.fit([b"alpha beta gamma delta " * 20] * 8, [b"spam | spam | " * 20] * 8)
    head = b"alpha beta gamma delta " * 200
    a, b = Q.evidence(model, iter([head, head + b"spam | spam | " * 2000]))
    assert b < a


def test_evidence_and_curve_against_plain_loops():
    import zstandard

    model = Q.fit([b"alpha beta gamma delta " * 20] * 8, [b"spam | spam | " * 20] * 8)
    text = b"alpha beta " * 900 + b"spam | " * 900
    sizes = []
    for raw in (model.good, model.bad):
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), level=Q.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(text[p : p + Q.BLOCK])) for p in range(0, len(text), Q.BLOCK)))
    assert Q.evidence(model, iter([text, b""])).tolist() == [(sizes[1] - sizes[0]) / (sizes[1] + sizes[0]), 0.0]
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x - 0.5)))).astype(float)
    slope, offset = Q.curve(x, y)
    loss = lambda a, b: np.mean(np.log1p(np.exp(-(2 * y - 1) * (a * x + b))))
    grid = [(loss(slope + i / 50, offset + j / 50), i, j) for i in range(-5, 6) for j in range(-5, 6)]
    assert min(grid)[1:] == (0, 0)


def test_long_and_repeated_labelled_texts_take_part(spark):
    rows = [(i, ("the river ran past old stone houses " if i % 2 else "buy | cheap | now ") * 5000) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    model = Q.train_quality(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"), Q.is_training())
    assert model.slope > 0
    assert all((r.score >= 0.5) == bool(r.id % 2) for r in Q.score_texts(docs, model).collect())
