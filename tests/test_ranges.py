"""Break lookups against a plain loop: lists and tables, few breaks and many, hot values."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F
from session_settings import settings

from spokeworks.operators import ranges, scoring
from spokeworks.operators.ranges import Break, band_label, with_band_label
from spokeworks.operators.search import count_reached


def expected(value, breaks, default=None):
    if value is None or math.isnan(value):
        return default
    label = default
    for b in sorted(breaks, key=lambda b: (-math.inf if b.limit is None else b.limit, b.after)):
        if b.limit is None or value > b.limit or value == b.limit and not b.after:
            label = b.label
    return label


VALUES = [None, math.nan, -math.inf, math.inf, -1.0, 0.0, 179.0, 179.5, 180.0, 190.0, 200.0, 200.5, 1e300]
BREAKS = [Break(None, "light"), Break(180.0, "medium"), Break(200.0, "heavy", after=True)]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "id int, v double")


@pytest.mark.parametrize("breaks", [BREAKS, BREAKS[1:], BREAKS[:1], [], [Break(180.0, "at"), Break(180.0, "past", after=True)]])
def test_lists(values, breaks):
    found = {r.id: r.band for r in with_band_label(values, "v", breaks, default="none").collect()}
    assert found == {i: expected(v, breaks, "none") for i, v in enumerate(VALUES)}


@pytest.mark.parametrize("size", [1, 3, 64, 65, 700])
@pytest.mark.parametrize("bin_size", [1, 7, 256])
def test_tables_of_any_size(spark, monkeypatch, size, bin_size):
    monkeypatch.setattr(ranges, "BIN_BREAKS", bin_size)
    rng = random.Random(size)
    breaks = [Break(float(rng.randint(0, 3 * size)), i, rng.random() < 0.5) for i in range(size)]
    least = {}
    for b in breaks:  # of equal breaks the smallest label counts
        least.setdefault((b.limit, b.after), b)
    points = [None, math.nan, -5.0, *(float(rng.randint(-2, 3 * size + 2)) for _ in range(400))]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(points)], "id int, v double")
    table = spark.createDataFrame([(b.limit, b.label, b.after) for b in breaks] + [(None, -1, False)], "limit double, label int, after boolean")
    want = {i: expected(v, list(least.values()), -7) for i, v in enumerate(points)}
    assert {r.id: r.band for r in with_band_label(frame, "v", table, default=-7).collect()} == want
    listed = with_band_label(frame, "v", list(least.values()), default=-7)
    assert {r.id: r.band for r in listed.collect()} == want


def test_long_lists_are_tables(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SHORT_LIST", 5)
    breaks = [Break(None, "start"), *(Break(10.0 * i, f"b{i}", i % 2 == 0) for i in range(20))]
    points = [None, -3.0, 0.0, 55.0, 60.0, 190.0, 500.0]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(points)], "id int, v double")
    found = {r.id: r.band for r in with_band_label(frame, "v", breaks, default="none").collect()}
    assert found == {i: expected(v, breaks, "none") for i, v in enumerate(points)}
    with pytest.raises(ValueError, match="with_band_label"):
        band_label(F.col("v"), breaks)


def test_a_hot_bin_is_split_and_nothing_is_compared_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BIN_BREAKS", 16)
    points = spark.range(60_000).select("id", F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id") / 60).alias("v"))
    table = spark.range(1000).select(F.col("id").cast("double").alias("limit"), F.col("id").alias("label"))
    off = {
        "spark__sql__autoBroadcastJoinThreshold": "-1",
        "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
        "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20KB",
        "spark__sql__shuffle__partitions": "32",
    }
    with settings(spark, **off):
        found = with_band_label(points, "v", table)
        assert found.filter("band <> floor(v)").isEmpty()
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_other_types(spark):
    days = spark.createDataFrame([("2024-05-01",), ("2023-01-01",), (None,)], "d string").select(F.col("d").cast("date").alias("d"))
    table = spark.createDataFrame([("2024-01-01", "new")], "limit string, label string").withColumn("limit", F.col("limit").cast("date"))
    assert sorted(r.band for r in with_band_label(days, "d", table, default="old").collect()) == ["new", "old", "old"]


def test_search_counts_what_is_reached(spark):
    for size in (0, 1, 2, 63, 64, 65, 200):
        limits = [F.lit(3 * i) for i in range(size)]
        frame = spark.range(-2, 605, 7)
        for form in (limits, F.array(*limits).cast("array<int>")):
            found = frame.select("id", count_reached(form, lambda x: F.col("id") >= x).alias("n")).collect()
            assert all(r.n == bisect.bisect_right(range(0, 3 * size, 3), r.id) for r in found)


def test_scoring_by_tables_equals_scoring_by_lists(spark):
    rows = [(i, str(70 + i), "20", "25", "true") for i in range(160)] + [(999, "abc", "20", "25", "true")]
    profiles = spark.createDataFrame(rows, "profile_id bigint, riderweight string, bikeweight string, tirewidth string, tubeless string")
    breaks = spark.createDataFrame([(-1e9, "light", False), (180.0, "medium", False), (200.0, "heavy", True)], "limit double, label string, after boolean")
    by_table = scoring.score_profiles(profiles, breaks=breaks).select("profile_id", "band", "psi")
    by_list = scoring.score_profiles(profiles).select("profile_id", "band", "psi")
    assert by_table.exceptAll(by_list).isEmpty() and by_list.exceptAll(by_table).isEmpty()
