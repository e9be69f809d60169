import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from tessera import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(rows):
    return sorted((tuple(round(x, 4) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert got
        return
    cur = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in cur.fetchall()]
    assert len(got) == len(want)
    assert normal(got) == normal(want)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["h3index", "value"] and df.count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
