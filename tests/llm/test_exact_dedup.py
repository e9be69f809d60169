import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import exact_dedup as X


def test_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 100, 30_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        f = X.build_filter(keys)
        assert X.in_filter(keys, *f).all()
        other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
        assert X.in_filter(other, *f).mean() < 0.02


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows for g in [groups[t or ""]])


ROWS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "A b"), (6, "é"), (7, "x" * 200_000), (8, "x" * 200_000)] + [(100 + i, "hot") for i in range(50)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, id string")


def test_against_brute_force(spark):
    assert sorted(map(tuple, X.exact_dedup(frame(spark, ROWS)).collect())) == brute(ROWS)


def test_weak_digest_is_settled_by_bytes(spark):
    weak = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 1).cast("binary")
    rows = ROWS + [(1000 + i, f"t{i % 300}") for i in range(600)]
    assert sorted(map(tuple, X.exact_dedup(frame(spark, rows), digest=weak).collect())) == brute(rows)


def test_empty_and_repeated_rows(spark):
    assert X.exact_dedup(frame(spark, [])).count() == 0
    got = X.exact_dedup(frame(spark, [(1, "a"), (1, "a"), (None, "b")])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [(None, None, 1, True), (1, 1, 2, True), (1, 1, 2, True)]


def test_empty_snapshot_and_a_large_batch(spark):
    rows = [(i, f"t{i % 700}") for i in range(2000)]
    got = X.exact_dedup(frame(spark, rows), in_snapshot=F.lit(False), bucket_rows=10).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_a_stored_snapshot_meets_later_batches(spark, tmp_path):
    old = [(i, f"t{i % 50}") for i in range(120)] + [(500, None), (501, "é")]
    path = f"file://{tmp_path}/snapshot"
    X.write_snapshot(frame(spark, old), path, bucket_rows=8)
    new = [(1000 + i, f"t{i % 80}") for i in range(200)] + [(2000, ""), (2001, "É"), (None, "t79"), (2001, "É")]
    stored = {}
    for i, t in old:
        stored[t or ""] = max(i, stored.get(t or "", -1))
    top = {}
    for i, t in new:
        top[t or ""] = max(i or -1, top.get(t or "", -1))
    for batch in (new, []):
        got = X.dedup_against(frame(spark, batch), X.open_snapshot(spark, path), bucket_rows=5).collect()
        want = [(i, stored.get(t or ""), stored.get(t or "", top[t or ""]), (t or "") not in stored and i == top[t or ""]) for i, t in batch]
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    X.write_snapshot(frame(spark, []), f"file://{tmp_path}/none")
    got = X.dedup_against(frame(spark, new), X.open_snapshot(spark, f"file://{tmp_path}/none")).collect()
    assert sum(r.kept for r in got) == len(set(top)) + 1 and all(r.known_id is None for r in got)  # one row came twice
