"""Keyed records, unique maps and flattening."""

import pytest
from pyspark.sql import functions as F

from spokeworks.operators import keyed, nested


@pytest.fixture(scope="module")
def records(spark):
    rows = [("example.com", "_a", "v1"), ("www.example.com", "_b", "v2"), ("api.example.com", "_c", "v3")]
    return spark.createDataFrame(rows, "domain string, record_name string, record_value string")


def test_records(records):
    found = keyed.keyed_records(records, "domain", {"name": "record_name", "value": "record_value"})
    assert found.schema.simpleString() == "struct<key:string,record:struct<name:string,value:string>>"
    assert found.filter("key = 'api.example.com'").first().record.asDict() == {"name": "_c", "value": "v3"}


def test_apex_and_www_are_left_out(records):
    kept = records.filter(keyed.outside_apex(F.col("domain"), F.lit("example.com")))
    assert [r.domain for r in kept.collect()] == ["api.example.com"]


def test_maps_are_whole_and_bounded(spark):
    i = F.col("id")
    pairs = spark.range(5000).select(
        F.when(i < 3000, "big").otherwise((i % 7).cast("string")).alias("zone"),
        i.cast("string").alias("name"),
        (i * 2).alias("value"),
    )
    maps = keyed.unique_key_maps(pairs, ["zone"], "name", "value", max_entries=400)
    sizes = maps.select("zone", "part", F.size("entries").alias("n")).collect()
    assert max(r.n for r in sizes) == 400
    assert sorted((r.part, r.n) for r in sizes if r.zone == "big") == [(p, 400) for p in range(7)] + [(7, 200)]
    back = maps.select("zone", F.explode("entries").alias("name", "value"))
    assert back.exceptAll(pairs).isEmpty() and pairs.exceptAll(back).isEmpty()


def test_one_whole_map_per_group(spark):
    rows = [("z", "b", 2), ("z", "a", 1), ("y", "a", 3), (None, "k", 4)]
    maps = keyed.unique_key_maps(spark.createDataFrame(rows, "zone string, name string, value int"), ["zone"], "name", "value")
    assert {r.zone: r.entries for r in maps.collect()} == {"z": {"a": 1, "b": 2}, "y": {"a": 3}, None: {"k": 4}}


def test_duplicate_key_fails(spark):
    rows = [("z", "a", "1"), ("z", "b", "1"), ("z", "a", "1")]
    pairs = spark.createDataFrame(rows, "zone string, name string, value string")
    with pytest.raises(Exception, match="duplicate key: a"):
        keyed.unique_key_maps(pairs, ["zone"], "name", "value").collect()
    with pytest.raises(Exception, match="duplicate key: a"):
        keyed.unique_key_maps(pairs, ["zone"], "name", "value", max_entries=1).collect()
    checked = keyed.require_unique(pairs, ["zone"], "name", "value")
    for reader in (checked.count, checked.select("zone").collect, checked.select("value").collect):
        with pytest.raises(Exception, match="duplicate key: a"):
            reader()
    for reader in (keyed.unique_key_maps(pairs, ["zone"], "name", "value").count,):
        with pytest.raises(Exception, match="duplicate key: a"):
            reader()
    other_zone = pairs.withColumn("zone", F.monotonically_increasing_id().cast("string"))
    assert keyed.unique_key_maps(other_zone, ["zone"], "name", "value").count() == 3


def test_flatten(spark):
    rows = [(1, [("first", ["a", "b"]), ("none", []), ("one", ["c"])]), (2, [])]
    table = spark.createDataFrame(rows, "id int, sections array<struct<title string, items array<string>>>")
    assert [tuple(r) for r in nested.flatten_sections(table).collect()] == [
        (1, 0, "first", 0, "a"), (1, 0, "first", 1, "b"), (1, 1, "none", None, None), (1, 2, "one", 0, "c"),
    ]
