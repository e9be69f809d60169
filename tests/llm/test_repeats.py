import hashlib
import random

import numpy as np
import pytest

from tessera.llm import repeats as R


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, t in data:
        for p in range(len(t) - 199):
            seen[t[p : p + 200]] = seen.get(t[p : p + 200], 0) + 1
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)

    def prose(n):
        return "".join(r.choice("abcdefgé ,.\n") for _ in range(n))

    passages = [prose(r.randint(150, 420)) for _ in range(6)]
    texts = []
    for _ in range(60):
        t = prose(r.randint(0, 300))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, 60)
            t += p[cut : len(p) - r.randint(0, 60)] + prose(r.randint(0, 200))
        texts.append(t)
    texts += [texts[3]] * 4 + ["ab" * 300, "x" * 199, "x" * 200, "x" * 201, "the " * 120, None, "", passages[0][:200], passages[0][1:201]]
    texts += [passages[1] + prose(5) for _ in range(40)] + [prose(5) + passages[1] for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[7])]


@pytest.mark.parametrize(("seed", "most"), [(1, R.MOST), (2, 3)])
def test_against_brute_force(spark, seed, most):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(4)
    got = sorted(map(tuple, R.cut_repeats(docs, most=most).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert R.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_has_the_anchors_of_its_windows(monkeypatch):
    raw = np.random.default_rng(0).integers(97, 110, 9000).astype(np.uint8)
    at = np.array([0, len(raw)])
    whole = [tuple(x) for part in R.anchors(raw, at) for x in zip(*part, strict=True)]
    monkeypatch.setattr(R, "_PART", 1000)
    parts = {tuple(x) for part in R.anchors(raw, at) for x in zip(*part, strict=True)}
    assert parts == set(whole)


def test_interval_tree():
    assert sorted(R.intervals(np.array([3, 5, 5, 0, 2]), 1)) == [(2, 4, 5), (3, 0, 3), (5, 1, 3)]


def test_long_text_has_each_anchor_once(monkeypatch):
    raw = np.random.default_rng(0).integers(97, 110, 9000).astype(np.uint8)
    at = np.array([0, len(raw)])
    whole = [tuple(x) for part in R.anchors(raw, at) for x in zip(*part, strict=True)]
    for part in (300, 1000, 1777):
        monkeypatch.setattr(R, "_PART", part)
        assert [tuple(x) for got in R.anchors(raw, at) for x in zip(*got, strict=True)] == whole


def test_text_of_several_parts_against_brute_force(spark):
    r = random.Random(6)
    prose = lambda n: "".join(r.choice("abcdefgh ,.") for _ in range(n))
    again = prose(260)
    rows = [(0, prose(2 * R._PART + 5000)), (1, prose(R._PART - 300) + again + prose(900)), (2, prose(50) + again), (3, "ab" * (R._PART // 2 + 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, R.cut_repeats(docs).collect()), key=str) == brute(rows)
