import zlib

import numpy as np
import pytest

from tessera.llm import packing as P


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers_library(reference, monkeypatch):
    texts = ["", "Hello  world\n\n\tx", "é ñ 漢字 🙂 a'll we've", "a<|endoftext|>b <|endoftext|>", "   ", "1234567 !!?? \r\n z", "x" * 500]
    for t in texts:
        assert list(P.token_ids(t)) == reference.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(P, "SEGMENT", 7)
    for t in texts + ["some words,  and   more \n words <|endoftext|> é"]:
        assert list(P.token_ids(t)) == reference.encode(t, add_special_tokens=False).ids


def test_ids_of_whole_documents_equal_the_library(reference):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    for t, want in zip(texts, reference.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        assert list(P.token_ids(t or "")) == want.ids


def test_repeated_rows_are_packed_each(spark):
    got = P.pack(spark.createDataFrame([(1, "a b c")] * 5, "doc_id long, text string")).collect()
    assert len(got) == 5 and len({(r.sequence_id, r.offset) for r in got}) == 5


def test_program_is_near_the_bound():
    rng = np.random.default_rng(0)
    demand = rng.integers(0, 400, 128)
    plan = P.plan_patterns(demand, 128)
    assert sum(p * t for p, t in plan).tolist() == demand.tolist()
    assert all(p @ np.arange(1, 129) <= 128 for p, _ in plan)
    used = sum(t for _, t in plan)
    bound = (demand @ np.arange(1, 129)) / 128
    assert used <= bound * 1.03 + 20
    _, x, least = P.column_generation(np.array([0, 0, 30, 0, 30, 0, 0]), 7)  # sizes 3 and 5: 3+3 or 5
    assert abs(x.sum() - 45) < 1e-6 and abs(least - 45) < 1e-6
    _, x, least = P.column_generation(demand, 128)
    assert least - 1e-6 <= x.sum() <= least * (1 + 1e-6) + 1e-6


def test_pieces_cover_everything_without_gaps(spark, reference):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["ab", "cde", "f,", "ghi jk"], rng.integers(0, 900)))) for i in range(150)] + [(500, None), (501, ""), (502, "long words here " * 5000), (7, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, size int").repartition(5)
    got = P.pack(docs).toPandas()
    want = sorted(len(reference.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert got["length"].sum() == sum(want)
    one = got[got.doc_id == 502].sort_values("start")
    ids = np.array(reference.encode("long words here " * 5000, add_special_tokens=False).ids + [0], dtype="<u4")
    for r in one.itertuples():
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert one["length"].sum() == len(ids) == one.doc_tokens.iloc[0]
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= P.CAPACITY
        assert (s.padded == (s.length.sum() if s.length.sum() in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512) else P.CAPACITY)).all()
    assert got.sequence_id.nunique() * P.CAPACITY <= 1.05 * sum(want) + 3 * P.CAPACITY


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
