import random

import pytest

import corpus_pipeline as P
from tests.llm.test_minhash import brute as near_brute


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    base = tmp_path_factory.mktemp("corpus")
    r = random.Random(6)
    good = ["the river ran past old stone houses and on", "we walked home along the quiet road at night", "she wrote a long letter to her old friend"]
    vocabulary = [w for s in good for w in s.split()] + [f"word{i}" for i in range(400)]
    texts = []
    for _ in range(120):
        base_text = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        texts.append(" ".join(base_text))
        if r.random() < 0.3:
            texts.append(" ".join(base_text))
        if r.random() < 0.3:
            base_text[r.randrange(len(base_text))] = "changed"
            texts.append(" ".join(base_text))
    texts += [" | ".join(["buy", "cheap", "now"] * r.randint(5, 30)) for _ in range(60)] + [None, "", None]
    r.shuffle(texts)
    rows = [(i, t, "en", "big" if r.random() < 0.7 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int("|" not in (t or "x")), 0) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base), rows


def test_every_stage_against_brute_force(spark, corpus):
    base, rows = corpus
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, base), name)
        held[name] = [tuple(x) for x in docs.collect()]
        if name != "pack":
            assert docs.columns == columns
    junk = {i for i, t, *_ in rows if t and "|" in t}
    after = {x[0] for x in held["quality"]}
    empty = {i for i, t, *_ in rows if not t}  # no evidence either way: the curve's offset decides
    assert not junk & after and after - empty == {i for i, *_ in rows} - junk - empty
    last = {}
    for i, t, *_ in sorted(held["quality"]):
        last[t or ""] = i
    assert {x[0] for x in held["exact"]} == set(last.values())
    kept = [i for i, _, _, keep in near_brute([(x[0], x[1]) for x in held["exact"]]) if keep]
    assert sorted(x[0] for x in held["near"]) == kept
    assert {x[0] for x in held["mix"]} == set(kept)
    tokens = {}
    for x in held["mix"]:
        tokens[x[3]] = tokens.get(x[3], 0) + len((x[1] or "").split())
    before = {}
    for x in held["near"]:
        before[x[3]] = before.get(x[3], 0) + len((x[1] or "").split())
    shares = sorted((before[s], tokens[s] / sum(tokens.values()) / (before[s] / sum(before.values()))) for s in before)
    assert shares[0][1] > 1 > shares[-1][1]  # small sources gain, the large one loses
    pieces = held["pack"]
    by = {}
    for i, start, n, _, total, *_ in pieces:
        by[i] = by.get(i, 0) + n
        assert start + n <= total
    copies = {}
    for x in held["mix"]:
        copies[x[0]] = copies.get(x[0], 0) + 1
    assert by == {i: next(p[4] for p in pieces if p[0] == i) * n for i, n in copies.items()}


def test_run_gives_pieces(spark, corpus):
    out = P.run(spark, corpus[0])
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


CLASH = ["kept_id", "kept_sha", "copies", "mix_id", "copy", "id", "sha", "n", "row", "component_id", "text_sha256", "kept", "a.b"]


def test_clashing_columns_null_ids_and_repeats(spark, tmp_path):
    texts = [f"the river ran past old stone houses number {i} and on to a place called {i * i}" for i in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s0", 1), (None, "a text without an id", None, None, None), (100, texts[5], "en", "s1", 2), (101, None, "en", "s1", 0)]
    rows = [(*r, *(f"{c}{k}" for c in CLASH)) for k, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        got = [tuple(r) for r in docs.collect()]
        assert set(got) <= set(rows)
        if name == "exact":
            assert sorted(got, key=str) == sorted((r for r in rows if r[0] != 5), key=str)  # 100 has the same text
    assert set(got) == {r for r in rows if r[0] != 5}
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(got)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0
