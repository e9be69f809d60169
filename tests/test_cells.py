import random

from pyspark.sql import functions as F

from tessera.functions import cells as C


def cell(k, res, base):
    h = (1 << 59) | (res << 52) | ((base + k // 7**res) << 45) | ((1 << 3 * (15 - res)) - 1)
    for i in range(1, res + 1):
        h |= (k // 7 ** (res - i) % 7) << 3 * (15 - i)
    return h


def test_known_ids():
    assert cell(8, 5, 25) == 599858370479915007
    assert C.py_to_parent(cell(8, 5, 25), 4) == 595354777294995455
    assert C.py_to_parent(cell(8, 5, 25), 3) == 590851229207232511


def test_expressions_match_plain_integers(spark):
    r = random.Random(2)
    ids = [cell(r.randrange(7**s), s, r.choice([4, 25, 14, 30, 121])) for s in range(0, 9) for _ in range(12)] + [cell(0, s, 4) for s in range(5)]
    df = spark.createDataFrame([(h,) for h in ids], "h long")
    C.register(spark)
    for row in df.select(
        "h", C.resolution("h").alias("r"), C.base_cell("h").alias("b"), C.is_pentagon("h").alias("p"), C.to_parent("h", 0).alias("up"), C.is_valid("h").alias("ok"),
        F.expr("h3_to_parent(h, 0)").alias("up2"), C.to_parent("h", C.resolution("h")).alias("same"), F.expr("h3_resolution(h)").alias("r2"), F.expr("h3_is_pentagon(h)").alias("p2"),
    ).collect():
        assert row.r == row.r2 == C.py_resolution(row.h) and row.b == C.py_base_cell(row.h) and row.p == row.p2
        assert row.up == row.up2 == C.py_to_parent(row.h, 0) and row.same == row.h and row.ok == C.py_is_valid(row.h)
    for res in (2, 4):
        low = df.where(C.resolution("h") <= res)
        for row in low.select("h", C.children("h", res).alias("c"), C.child_count("h", res).alias("n"), F.expr(f"h3_to_children(h, {res})").alias("c2"), F.expr(f"h3_child_count(h, {res})").alias("n2")).collect():
            assert sorted(row.c) == sorted(row.c2) == sorted(C.py_children(row.h, res)) and row.n == row.n2 == len(row.c)
            assert all(C.py_to_parent(x, C.py_resolution(row.h)) == row.h for x in row.c)


def test_pentagon_counts():
    assert [len(C.py_children(cell(0, 0, 4), d)) for d in (1, 2, 3)] == [6, 41, 286]


def test_invalid_cells(spark):
    good = cell(10, 3, 25)
    bad = [0, 1, good ^ (1 << 59), good | (1 << 56), (good & ~(127 << 45)) | (122 << 45), good | (7 << 36), cell(1, 3, 4), -good]
    df = spark.createDataFrame([(h,) for h in bad] + [(None,), (good,)], "h long")
    assert [r.ok for r in df.select(C.is_valid("h").alias("ok")).collect()] == [False] * (len(bad) + 1) + [True]
    assert not any(map(C.py_is_valid, bad))


def test_change_resolution(spark):
    df = spark.createDataFrame([(cell(3, 4, 25),), (cell(4, 4, 25),), (cell(9, 2, 25),)], "h3index long")
    got = sorted(r.h3index for r in C.change_resolution(df, 3).collect())
    assert got == sorted({C.py_to_parent(cell(3, 4, 25), 3), *C.py_children(cell(9, 2, 25), 3)})
