import random
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.catalog import cell as cell_column
from tessera.errors import DatabaseNotFound, EmptyCells, InvalidCell, MissingQueryPlaceholder, StorageError, TableSetNotFound, UnsupportedResolution
from tessera.functions import cells as C
from tessera.operators.aggregate import aggregate_to, cascade
from tessera.operators.compact import compact, uncompact
from tessera.operators.dedupe import merge_rows
from tessera.operators.traverse import select_traversal_resolution, traverse_tableset_area_of_interest
from tessera.plans.query import TableSetQuery
from tessera.plans.schema import BATCH, TableEngine, TableSetSchemaBuilder
from tessera.sources.store import CellStore, InsertOptions
from tests.test_cells import cell


@pytest.fixture(scope="module")
def store(spark):
    return CellStore(spark, "cells_test", create_db=True)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_methods_on_siblings(spark):
    kids = C.py_children(cell(3, 2, 25), 3)
    df = spark.createDataFrame([(k, float(i + 1), float(i + 1), float(i + 1), float(i + 1), float(i + 1)) for i, k in enumerate(kids)], "h3index long, s double, x double, n double, a double, r double")
    m = {"s": "sum", "x": "max", "n": "min", "a": "average", "r": "relativetocellarea"}
    assert rows(aggregate_to(df, 3, 2, m)) == [(cell(3, 2, 25), 28.0, 7.0, 1.0, 4.0, 4.0)]
    part = spark.createDataFrame([(k, 4.0) for k in kids[:3]], "h3index long, r double")
    assert abs(aggregate_to(part, 3, 2, {"r": "relativetocellarea"}).first().r - 12 / 7) < 1e-9
    five = cell(0, 2, 4)
    assert aggregate_to(spark.createDataFrame([(k, 2.0) for k in C.py_children(five, 3)], "h3index long, r double"), 3, 2, {"r": "relativetocellarea"}).first().r == 2.0


def test_set_null_on_conflict(spark):
    p = [cell(i, 2, 25) for i in range(3)]
    data = [(C.py_children(p[0], 3)[i], v) for i, v in enumerate([23, 23, 12])] + [(C.py_children(p[1], 3)[i], v) for i, v in enumerate([23, None])] + [(C.py_children(p[2], 3)[0], None)]
    got = dict(rows(aggregate_to(spark.createDataFrame(data, "h3index long, c int"), 3, 2, {"c": "setnullonconflict"})))
    assert got == {p[0]: None, p[1]: 23, p[2]: None}


def test_average_is_an_average_of_averages(spark):
    a, b = C.py_children(cell(0, 2, 25), 3)[:2]
    df = spark.createDataFrame([(C.py_children(a, 4)[0], 10.0)] + [(k, 0.0) for k in C.py_children(b, 4)], "h3index long, v double")
    assert cascade({4: df}, [2, 3, 4], {"v": "average"})[2].first().v == 5.0


@pytest.mark.parametrize("base", [4, 25])
def test_compaction_round_trip(spark, base):
    r = random.Random(base)
    top = cell(0, 1, base)
    whole = C.py_children(top, 4)
    data = [(h, 1) for h in whole] + [(h, r.randrange(2)) for h in C.py_children(cell(2, 1, base), 4)]
    df = spark.createDataFrame(data + data[:5], "h3index long, v int")
    small = compact(df, 4)
    assert (top, 1) in rows(small) and small.count() <= len(data) - len(whole) + 1
    assert rows(uncompact(small, 4)) == sorted(data, key=str)


def test_engines(spark):
    df = spark.createDataFrame([(1, 5, 2.0, 1), (1, 5, 3.0, 2), (1, 5, 3.0, 2), (2, 7, 1.0, 1)], f"h3index long, k int, v double, {BATCH} long")
    assert rows(merge_rows(df, TableEngine("replacing"), ["h3index"]).drop(BATCH)) == [(1, 5, 3.0), (2, 7, 1.0)]
    assert rows(merge_rows(df, TableEngine("summing", ("v",)), ["h3index"]).drop(BATCH)) == [(1, 5, 5.0), (2, 7, 1.0)]
    once = merge_rows(df, TableEngine("aggregating"), ["h3index"])
    assert rows(once) == rows(merge_rows(once, TableEngine("aggregating"), ["h3index"])) and once.count() == 2


def elephants(name, resolutions=(1, 2, 3, 4), **kw):
    b = TableSetSchemaBuilder(name).h3_base_resolutions(list(resolutions)).temporal_partitioning("month").add_column("is_valid", "UInt8")
    b.add_aggregated_column("density", "Float32", "RelativeToCellArea").add_aggregated_column("category", "UInt8", "setnullonconflict", nullable=True)
    return b


def test_insert_and_query(store, spark):
    schema = elephants("eleph").build()
    area = [h for k in (3, 4, 9) for h in C.py_children(cell(k, 2, 25), 4)] + C.py_children(cell(60, 3, 25), 4)[:4]
    frame = pd.DataFrame({"h3index": area, "is_valid": 1, "density": 4.0, "category": [23 if i < 70 else 12 for i in range(len(area))]})
    store.insert_h3dataframe_into_tableset(schema, frame)
    full = store.query_tableset_cells("eleph", TableSetQuery(), area, 4)
    assert full.columns == ["h3index", "category", "density", "is_valid"] and full.count() == len(area)
    assert rows(full.select("h3index", "category")) == sorted(zip(area, frame["category"].tolist(), strict=True), key=str)
    coarse = store.query_tableset_cells("eleph", TableSetQuery(), area, 2)
    found = {r.h3index: r for r in coarse.collect()}
    assert len(found) == len({C.py_to_parent(h, 2) for h in area}) and any(r.category is None for r in found.values())
    assert abs(found[cell(3, 2, 25)].density - 4.0) < 1e-6 and found[C.py_to_parent(area[-1], 2)].density < 1
    # cells coarser than the target, as a list, as a frame, mixed
    want = [h for h in area if C.py_to_parent(h, 2) == cell(4, 2, 25)]
    for w in ([cell(4, 2, 25)], [cell(4, 2, 25), want[0]], spark.createDataFrame([(cell(4, 2, 25),), (want[3],)], "h3index long")):
        assert sorted(r.h3index for r in store.query_tableset_cells("eleph", TableSetQuery(), w, 4).collect()) == sorted(want)
    raw = store.query_tableset_cells("eleph", TableSetQuery(), [want[0]], 4, do_uncompact=False).collect()
    assert len(raw) == 1 and C.py_to_parent(want[0], C.py_resolution(raw[0].h3index)) == raw[0].h3index and C.py_resolution(raw[0].h3index) < 4
    stats = {r.resolution: r for r in store.tableset_stats("eleph").collect()}
    assert stats[4].num_cells == len(area) and stats[4].num_cells_stored_at_resolution + stats[4].num_cells_stored_compacted < len(area)


def test_pushdown_reaches_the_scan(store):
    plan = store.query_tableset_cells("eleph", TableSetQuery(), [cell(3, 4, 25)], 4)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(h3index_p_cell" in plan and "In(h3index" in plan or "EqualTo(h3index" in plan


def test_templates(store):
    area = [cell(3, 2, 25)]
    q = lambda s: store.query_tableset_cells("eleph", TableSetQuery.from_template(s), area, 4)
    assert q("select * from <[table]> where density < 2 and h3index in <[h3indexes]>").count() == 0
    assert q("select h3index, density * 2 as twice from <[table]> where h3index in <[h3indexes]>").first().twice == 8.0
    with pytest.raises(MissingQueryPlaceholder):
        q("select * from <[table]>")
    with pytest.raises(IOError, match="non_existing"):
        q("select non_existing from <[table]> where h3index in <[h3indexes]>")


def test_replacing_and_repeated_batches(store):
    b = TableSetSchemaBuilder("twice").h3_base_resolutions([2, 3]).add_aggregated_column("v", "Float64", "max").add_column("day", "Date", order_key_position=0)
    schema = b.temporal_partitioning("2 years").build()
    day = pd.Timestamp("2020-03-01").date()
    kids = C.py_children(cell(5, 2, 25), 3)[:3]
    for v in (1.0, 7.0):
        store.insert_h3dataframe_into_tableset(schema, pd.DataFrame({"h3index": kids, "v": v, "day": day}))
    got = store.query_tableset_cells("twice", TableSetQuery(), kids, 3).collect()
    assert sorted((r.h3index, r.v) for r in got) == sorted((k, 7.0) for k in kids)
    store.insert_h3dataframe_into_tableset(schema, pd.DataFrame({"h3index": kids, "v": 9.0, "day": day}), InsertOptions(deduplicate_after_insert=False))
    assert store.query_tableset_cells("twice", TableSetQuery(), kids, 3).count() == 6
    store.deduplicate_schema(schema)
    assert {r.v for r in store.query_tableset_cells("twice", TableSetQuery(), kids, 3).collect()} == {9.0}


def test_sum_turns_compaction_off(store):
    schema = TableSetSchemaBuilder("sums").h3_base_resolutions([2, 3]).add_aggregated_column("n", "UInt32", "sum").build()
    kids = C.py_children(cell(5, 2, 25), 3)
    store.insert_h3dataframe_into_tableset(schema, pd.DataFrame({"h3index": kids, "n": 2}))
    assert store.query_tableset_cells("sums", TableSetQuery(), [cell(5, 2, 25)], 2).first().n == 14
    assert [r.num_cells_stored_compacted for r in store.tableset_stats("sums").collect()] == [0, 0]


def test_gaps_between_base_resolutions(store):
    schema = TableSetSchemaBuilder("gaps").h3_base_resolutions([1, 4]).add_aggregated_column("v", "Float64", "average").build()
    area = C.py_children(cell(9, 2, 25), 4) + C.py_children(cell(10 * 49, 4, 25), 4)
    store.insert_h3dataframe_into_tableset(schema, pd.DataFrame({"h3index": area, "v": [1.0] * 49 + [51.0]}))
    assert store.query_tableset_cells("gaps", TableSetQuery(), [cell(1, 1, 25)], 1).first().v == 2.0


def test_lower_resolution_partitions(store):
    schema = elephants("lower").h3_partitioning("lower_resolution", 3).build()
    area = C.py_children(cell(3, 3, 25), 4)
    store.insert_h3dataframe_into_tableset(schema, pd.DataFrame({"h3index": area, "is_valid": 1, "density": 1.0, "category": 1}))
    assert store.query_tableset_cells("lower", TableSetQuery(), area, 4).count() == 7


def test_errors(store, spark):
    schema = elephants("errs").build()
    frame = lambda ids: pd.DataFrame({"h3index": ids, "is_valid": 1, "density": 1.0, "category": 1})
    with pytest.raises(InvalidCell):
        store.insert_h3dataframe_into_tableset(schema, frame([12]))
    with pytest.raises(UnsupportedResolution):
        store.insert_h3dataframe_into_tableset(schema, frame([cell(0, 6, 25)]))
    with pytest.raises(TableSetNotFound):
        store.get_tableset("nothing")
    with pytest.raises(DatabaseNotFound):
        CellStore(spark, "no_such_db")
    with pytest.raises(StorageError, match="nope"):
        store.execute_into_dataframe("select nope from range(1)")
    with pytest.raises(EmptyCells):
        store.query_tableset_cells("eleph", TableSetQuery(), [], 4)
    with pytest.raises(UnsupportedResolution):
        store.query_tableset_cells("eleph", TableSetQuery(), [cell(0, 6, 25)], 6)
    stop = InsertOptions()
    stop.abort.set()
    with pytest.raises(KeyboardInterrupt):
        store.insert_h3dataframe_into_tableset(schema, frame([cell(0, 4, 25)]), stop)
    store.insert_h3dataframe_into_tableset(schema, frame([])[:0])
    store.drop_tableset("errs")
    store.drop_tableset("errs")
    assert "errs" not in store.list_tablesets()


def test_plain_tables(store):
    store.execute("create table if not exists plain (id bigint, name string) using parquet")
    store.insert_dataframe("plain", pd.DataFrame({"name": ["one", "two"], "id": [1, 2]}))
    assert rows(store.execute_into_dataframe("select * from plain")) == [(1, "one"), (2, "two")]
    f = store.execute_into_h3dataframe(f"select explode(kids) as my_h3index, 'x' as name from (select h3_to_children({cell(3, 5, 25)}, 8) as kids)", "my_h3index")
    assert f.to_pandas().shape == (343, 2) and f.h3index_column_name == "my_h3index" and f.to_arrow().num_rows == 343


def test_traversal(store):
    assert [select_traversal_resolution(range(8), 7, n) for n in (500, 7, 1)] == [4, 6, 7]
    area = [cell(3, 2, 25), cell(4, 2, 25), cell(77, 2, 25)]
    t = traverse_tableset_area_of_interest(store, "eleph", TableSetQuery(), area, 4, max_fetch_count=50)
    assert t.traversal_resolution == 2 and len(t) == 3
    got = {c: table.num_rows for c, table in t}
    assert got == {area[0]: 49, area[1]: 49}
    assert {r.traversal_cell: r["count"] for r in t.frame().groupBy("traversal_cell").count().collect()} == got
    none = traverse_tableset_area_of_interest(store, "eleph", TableSetQuery(), area, 4, max_fetch_count=50, filter_query=TableSetQuery.from_template("select h3index from <[table]> where false and h3index in <[h3indexes]>"))
    assert list(none) == [] and len(none) == 3
    bad = traverse_tableset_area_of_interest(store, "eleph", TableSetQuery(), area, 4, filter_query=TableSetQuery.from_template("select nix from <[table]> where h3index in <[h3indexes]>"))
    with pytest.raises(IOError):
        list(bad)


def test_streaming_insert(store, spark, tmp_path):
    from tessera.streaming.ingest import insert_stream

    schema = elephants("streamed", resolutions=(2, 3)).build()
    kids = C.py_children(cell(5, 2, 25), 3)
    spark.createDataFrame([(k, 1, 2.0, 1) for k in kids], "h3index long, is_valid int, density double, category int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("h3index long, is_valid int, density double, category int").parquet(f"{tmp_path}/in")
    q = insert_stream(store, schema, stream, f"{tmp_path}/ck", availableNow=True)
    q.awaitTermination(120)
    assert store.query_tableset_cells("streamed", TableSetQuery(), kids, 3).agg(F.sum("density")).first()[0] == 14.0


@pytest.mark.parametrize("engine,price", [(("replacing", None), 2.0), (("summing", ["price"]), 3.0)])
def test_a_batch_with_repeated_keys(store, engine, price):
    b = TableSetSchemaBuilder("again_" + engine[0]).h3_base_resolutions([4, 5]).table_engine(*engine)
    schema = b.add_aggregated_column("price", "Float64", "sum").build()
    c = cell(3, 5, 25)
    store.insert_h3dataframe_into_tableset(schema, pd.DataFrame({"h3index": [c, c], "price": [1.0, 2.0]}))
    for r in (5, 4):
        got = store.query_tableset_cells(schema.name, TableSetQuery(), [C.py_to_parent(c, r)], r).collect()
        assert [x.price for x in got] == [price]


def test_abort_cancels_what_runs(store, spark):
    schema = TableSetSchemaBuilder("stopped").h3_base_resolutions([4, 5]).add_aggregated_column("v", "Float64", "max").build()

    @F.udf("double")
    def slow(i):
        time.sleep(0.5)
        return float(i)

    rows = spark.range(0, 400, 1, 4).select(cell_column("id", 5).alias("h3index"), slow("id").alias("v"))
    options = InsertOptions()
    threading.Timer(2, options.abort.set).start()
    began = time.time()
    with pytest.raises(KeyboardInterrupt):
        store.insert_h3dataframe_into_tableset(schema, rows, options)
    assert time.time() - began < 40


def test_lower_resolution_partitions_are_pruned(store):
    b = TableSetSchemaBuilder("pruned").h3_base_resolutions([4, 5]).h3_partitioning("lowerresolution", 3)
    schema = b.add_aggregated_column("v", "Int64", "max").build()
    ids = [cell(k, 5, 25) for k in (0, 400, 900)]
    store.insert_h3dataframe_into_tableset(schema, pd.DataFrame({"h3index": ids, "v": [1, 2, 3]}))
    df = store.query_tableset_cells("pruned", TableSetQuery(), ids[1:2], 5)
    assert [r.v for r in df.collect()] == [2]
    assert "PartitionFilters: [" in (plan := df._jdf.queryExecution().toString()) and "_p_cell" in plan.split("PartitionFilters: [", 1)[1][:200]
