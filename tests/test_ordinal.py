"""Ordinals against plain windows, hot keys included."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from session_settings import settings

from spokeworks.operators import counts
from spokeworks.operators.ordinal import add_ordinal, bucket_runs, fit_splitters, hot_keys, key_counts, number_rows


@pytest.fixture(autouse=True, scope="module")
def small_partitions(spark):
    """Keep all shuffle partitions, which AQE would merge for so few rows."""
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        yield


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows have one key, one more third is NULL, the rest is spread."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 3 == 1, F.lit(None)).otherwise((i % 500).cast("string"))
    return spark.range(30_000).select(key.alias("key"), F.xxhash64("id").alias("at"), "id")


@pytest.mark.parametrize("hot_key_rows", [1, 1_000_000], ids=["split", "window"])
def test_per_key(skewed, hot_key_rows):
    window = Window.partitionBy("key").orderBy("at", "id")
    expected = skewed.withColumn("n", F.row_number().over(window).cast("bigint"))
    assert same(add_ordinal(skewed, ["at", "id"], ["key"], "n", hot_key_rows), expected)


def test_shuffled_join_of_places(spark, skewed):
    """Without broadcasts, as for more keys than fit in one."""
    window = Window.partitionBy("key").orderBy("at", "id")
    expected = skewed.withColumn("n", F.row_number().over(window).cast("bigint"))
    off = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1"}
    with settings(spark, **off):
        numbered = number_rows(skewed, ["at", "id"], ["key"], "n")
        assert "SortMergeJoin" in numbered._jdf.queryExecution().executedPlan().toString()
        assert same(numbered, expected)


def test_whole_table(skewed):
    expected = skewed.withColumn("n", F.row_number().over(Window.orderBy("at", "id")).cast("bigint"))
    assert same(add_ordinal(skewed, ["at", "id"], name="n"), expected)


def test_two_key_columns(skewed):
    table = skewed.withColumn("half", F.col("id") % 2)
    window = Window.partitionBy("half", "key").orderBy("at", "id")
    expected = table.withColumn("n", F.row_number().over(window).cast("bigint"))
    assert same(add_ordinal(table, ["at", "id"], ["half", "key"], "n", 1), expected)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "key string, id bigint")
    assert add_ordinal(empty, ["id"], ["key"]).isEmpty()
    assert add_ordinal(empty, ["id"]).isEmpty()


@pytest.mark.parametrize("partitions", ["2", "8"])
def test_hot_keys_do_not_depend_on_the_session(spark, skewed, partitions):
    """With two partitions no key has an average share, and the hot ones still go to several tasks."""
    with settings(spark, spark__sql__shuffle__partitions=partitions):
        assert {r.key for r in hot_keys(key_counts(skewed, ["key"]), ["key"], 100).collect()} == {"hot", None}
        assert {r.key for r in hot_keys(key_counts(skewed, ["key"]), ["key"], 9_999).collect()} == {"hot", None}
        assert hot_keys(key_counts(skewed, ["key"]), ["key"], 10_000).isEmpty()
        assert buckets_of(skewed).count("hot") > 1


def buckets_of(table):
    """The key of every (bucket, key) pair."""
    splitters = fit_splitters(table, ["key", "at", "id"])
    return [r.key for r in bucket_runs(table, splitters, ["key"]).collect()]


def test_hot_key_uses_several_tasks(skewed):
    runs = bucket_runs(skewed, fit_splitters(skewed, ["key", "at", "id"]), ["key"])
    hot = [r.n for r in runs.collect() if r.key == "hot"]
    assert len(hot) > 4 and sum(hot) == 10_000
    assert max(hot) < 3_000


def test_buckets_are_even_and_ordered(spark, skewed):
    """Also where all rows agree but in the last sort column, and whatever split the table has."""
    for table, order in ((skewed, ["at", "id"]), (skewed.withColumn("at", F.lit(1)), ["at", "id"])):
        splitters = fit_splitters(table, order, 32)
        assert splitters.limits.collect() == fit_splitters(table.repartition(5, "id"), order, 32).limits.collect()
        sizes = {r["__bucket"]: r.n for r in bucket_runs(table, splitters).collect()}
        assert len(sizes) == 32 and max(sizes.values()) < 2 * 30_000 / 32
        placed = splitters.with_bucket(table).withColumnRenamed("__bucket", "b").groupBy("b").agg(F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi"))
        ends = [(r.lo, r.hi) for r in placed.orderBy("b").collect()]
        assert all(tuple(a[1]) < tuple(b[0]) for a, b in zip(ends, ends[1:]))


KINDS = {
    "instant": "timestamp_micros(id * 3600000123)",
    "wall": "CAST(timestamp_micros(id * 3600000123) AS timestamp_ntz)",
    "day": "date_add(DATE '2024-01-01', CAST(id AS int))",
    "text": "concat('ä', CAST(id AS string))",
    "real": "CASE WHEN id = 3 THEN double('NaN') WHEN id = 4 THEN double('-Infinity') ELSE id / 7 END",
    "exact": "CAST(id / 3 AS decimal(20,5))",
    "bytes": "unhex(lpad(hex(id * 37), 6, '0'))",
    "gone": "CASE WHEN id % 3 > 0 THEN id END",
}


@pytest.mark.parametrize("kind", list(KINDS))
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_order_of_every_type(spark, kind, zone):
    """NULLs and NaN included, in any time zone."""
    with settings(spark, spark__sql__session__timeZone=zone):
        table = spark.range(500).select(F.expr(KINDS[kind]).alias("v"), "id")
        expected = table.withColumn("n", F.row_number().over(Window.orderBy("v", "id")).cast("bigint"))
        assert same(add_ordinal(table, ["v", "id"], name="n"), expected)


def test_no_row_is_written_on_the_way(spark, skewed, monkeypatch):
    """Only small tables are written: the hot keys, and a shift for each bucket and key."""
    from spokeworks.operators import ordinal

    written, keep = {}, ordinal.scratch_table

    def record(df, label, folder=None):
        table = keep(df, label, folder)
        written.setdefault(label, table)
        return table

    monkeypatch.setattr(ordinal, "scratch_table", record)
    wide = skewed.withColumn("more", F.lit("x"))
    add_ordinal(wide, ["at", "id"], ["key"], "n", 100).count()
    add_ordinal(wide, ["at", "id"], name="n").count()
    assert set(written) == {"hot", "shifts", "splitters"}
    assert written["splitters"].count() == 1 and written["shifts"].count() < 200 and "more" not in written["shifts"].columns


@pytest.mark.parametrize("hot_key_rows", [1, 1_000_000], ids=["split", "window"])
def test_continues_from_a_start(spark, skewed, hot_key_rows):
    starts = {"hot": 100, None: 7, "2": 5, "absent": 9}
    start = spark.createDataFrame(list(starts.items()), "key string, start bigint")
    numbered = add_ordinal(skewed, ["at", "id"], ["key"], "n", hot_key_rows, start=start)
    window = Window.partitionBy("key").orderBy("at", "id")
    earlier = F.when(F.col("key").isNull(), 7).when(F.col("key") == "hot", 100).when(F.col("key") == "2", 5)
    expected = skewed.withColumn("n", F.row_number().over(window) + F.coalesce(earlier, F.lit(0)).cast("bigint"))
    assert same(numbered, expected)


def test_no_window_gathers_the_rows(skewed):
    plan = add_ordinal(skewed, ["at", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert plan.count("Exchange hashpartitioning(__bucket") == plan.count("Exchange") == 1


def test_visit_totals(skewed):
    totals = {r.key: r.visits for r in counts.visit_totals(skewed, ["key"]).collect()}
    assert totals["hot"] == totals[None] == 10_000
    assert counts.visit_totals(skewed).first().visits == 30_000


def test_many_buckets_are_planned_quickly(spark):
    """Plans do not grow with the splitters."""
    import time

    rows = spark.range(0, 200_000, 1, 4).select(F.xxhash64("id").alias("h"), F.lit("one").alias("src"), "id")
    start = time.time()
    found = number_rows(rows, ["h", "id"], ["src"], "n", buckets=4_000)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert found.agg(F.max("n"), F.countDistinct("n")).first()[:] == (200_000, 200_000)
    assert time.time() - start < 60
