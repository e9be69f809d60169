import pytest
from pyspark.sql import functions as F

from tessera.errors import NoResolutionsDefined, SchemaValidationError, UnsupportedResolution
from tessera.plans import schema as S
from tessera.plans import tableset as N


def builder(name="elephants"):
    return (
        S.TableSetSchemaBuilder(name).h3_base_resolutions([0, 3, 5]).temporal_partitioning("month")
        .add_column("is_valid", "UInt8", compression_method=S.CompressionMethod("Gorilla"))
        .add_aggregated_column("density", "Float32", "RelativeToCellArea")
        .add_aggregated_column("category", "UInt8", "setnullonconflict", nullable=True)
    )


def test_names():
    assert N.table_name("some_table", 5, False) == "some_table_05_base"
    assert N.table_name("some_table", 5, False, has_base_suffix=False) == "some_table_05"
    t = N.parse_table_name("some_ta78ble_05_base_tmp5t")
    assert (t.basename, t.resolution, t.is_compacted, t.temporary_key) == ("some_ta78ble", 5, False, "5t")
    t = N.parse_table_name("elephants_01_compacted")
    assert (t.basename, t.resolution, t.is_compacted) == ("elephants", 1, True) and t.name == "elephants_01_compacted"
    assert N.parse_table_name("columns") is None and not N.parse_table_name("x1y_03").has_base_suffix


def test_find_tablesets():
    names = [f"water_{r:02}_{k}" for r in range(14) for k in ("base", "compacted")] + ["something_else_06", "something_else_07", "elephants_02_base", "elephants_03_base", "elephants_01_compacted", "elephants_02_base_tmp1", "columns"]
    got = N.find_tablesets(names)
    assert sorted(got) == ["elephants", "something_else", "water"]
    assert got["water"].num_tables == 28 and got["elephants"].base_resolutions == [2, 3] and got["elephants"].compacted_resolutions == [1]
    with pytest.raises(UnsupportedResolution):
        got["elephants"].tables_to_satisfy_query(5)
    assert [t.name for t in got["elephants"].tables_to_satisfy_query(3)] == ["elephants_03_base", "elephants_01_compacted"]


def test_usable_columns():
    assert N.usable_columns([[("h3index", "bigint"), ("a", "int"), ("b", "int")], [("h3index", "bigint"), ("a", "int"), ("b", "string")]]) == {"a": "int"}


@pytest.mark.parametrize("name", ["", " test", "4test", "ab"])
def test_bad_names(name):
    with pytest.raises(SchemaValidationError):
        builder(name).build()


def test_partitioning_strings():
    assert S.TemporalPartitioning.parse("5 years") == S.TemporalPartitioning("years", 5)
    assert S.TemporalPartitioning.parse("month") == S.TemporalPartitioning("months", 1)
    for bad in ("0 years", "z years", "3 weeks"):
        with pytest.raises(ValueError):
            S.TemporalPartitioning.parse(bad)


def test_partition_values(spark):
    df = spark.sql("SELECT explode(array(date'2019-01-05', date'2019-02-01', date'2019-12-31', date'2020-05-05', date'2021-01-01', date'2022-01-01')) AS d")
    month = [r[0] for r in df.select(S.TemporalPartitioning("months", 1).expression(F.col("d"))).collect()]
    assert month[:3] == [201900, 201909, 201992]
    assert [r[0] for r in df.select(S.TemporalPartitioning("years", 3).expression(F.col("d"))).collect()] == [2019, 2019, 2019, 2019, 2019, 2022]
    assert len({r[0] for r in df.select(S.TemporalPartitioning("months", 6).expression(F.col("d"))).collect()}) == 5


def test_validation():
    with pytest.raises(NoResolutionsDefined):
        builder().h3_base_resolutions([]).build()
    with pytest.raises(UnsupportedResolution):
        builder().h3_base_resolutions([16]).build()
    with pytest.raises(SchemaValidationError):
        builder().add_aggregated_column("s", "String", "sum").build()
    with pytest.raises(SchemaValidationError):
        builder().add_aggregated_column("c", "UInt8", "setnullonconflict").build()
    with pytest.raises(SchemaValidationError):
        builder().table_engine("SummingMergeTree", ["nope"]).build()
    with pytest.raises(SchemaValidationError):
        builder().compression_method(S.CompressionMethod("zstd", 40)).build()
    with pytest.raises(SchemaValidationError):
        builder().partition_by(["nope"]).build()
    with pytest.raises(SchemaValidationError):
        builder().add_column("t1", "Date", order_key_position=0).add_column("t2", "Date", order_key_position=1).build()
    for bad in (lambda b: b.add_column("x", "Decimal"), lambda b: b.add_aggregated_column("x", "Int8", "median"), lambda b: b.table_engine("log"), lambda b: b.temporal_resolution("week"), lambda b: b.h3_partitioning("hash")):
        with pytest.raises(ValueError):
            bad(builder())
    with pytest.raises(ValueError):
        S.CompressionMethod("brotli")


def test_order_key_and_json():
    s = builder().add_column("b", "Int32", order_key_position=0).add_column("a", "Int32", order_key_position=0).build()
    assert s.order_key() == ["h3index", "a", "b"]
    again = S.TableSetSchema.from_json_string(s.to_json_string())
    assert again == s and again.sql_statements() == s.sql_statements() and len(s.sql_statements()) == 3 + 6
    assert S.CompressionMethod("LZ4HC").param == 9 and S.CompressionMethod("delta").param == 1
    with pytest.raises(SchemaValidationError):
        S.TableSetSchema.from_json_string("{}")


def test_order_of_resolutions():
    assert sorted([S.ResolutionMetadata(3, True), S.ResolutionMetadata(3, False), S.ResolutionMetadata(1, True)]) == [(1, True), (3, False), (3, True)]
    assert S.temporary_key() != S.temporary_key() or S.temporary_key().count("_") == 2
