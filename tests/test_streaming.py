"""Streams over many micro-batches against the batch jobs, and repeated batches."""

import shutil

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spokeworks.plans import visits as plans
from spokeworks.streaming import visits as streams

SCHEMA = "event_id bigint, ts timestamp_ntz, key string"
BATCHES = 7


@pytest.fixture(scope="module")
def events(spark):
    """A third of all hits go to one key, some keys are NULL."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 50 == 1, F.lit(None)).otherwise((i % 20).cast("string"))
    at = F.timestamp_seconds(i * 7919 % 5000).cast("timestamp_ntz")
    return spark.range(2100).select(i.alias("event_id"), at.alias("ts"), key.alias("key"))


@pytest.fixture(scope="module")
def feed(events, tmp_path_factory):
    """One file per micro-batch, oldest file first; batch n holds ids n*300 to n*300+299."""
    import os

    folder = tmp_path_factory.mktemp("feed")
    for n in range(BATCHES):
        part = events.filter((F.col("event_id") >= n * 300) & (F.col("event_id") < (n + 1) * 300))
        target = folder / f"{n}.parquet"
        part.toPandas().to_parquet(target, coerce_timestamps="us")
        os.utime(target, (1_000_000 + n, 1_000_000 + n))
    return str(folder)


def source(spark, feed):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed)


@pytest.fixture(scope="module")
def expected(events):
    """Arrival order first, then time, per key."""
    arrival = F.floor(F.col("event_id") / 300)
    window = Window.partitionBy("key").orderBy(arrival, "ts", "event_id")
    return events.withColumn("visit_no", F.row_number().over(window).cast("bigint"))


def run_ordinals(spark, feed, folder, hot_key_rows=50):
    query = streams.start_visit_ordinals(
        source(spark, feed), ["key"], ["ts", "event_id"], f"{folder}/out", f"{folder}/ck",
        hot_key_rows=hot_key_rows, availableNow=True,
    )
    query.awaitTermination()


def same(left, right):
    columns = sorted(right.columns)
    left, right = left.select(columns), right.select(columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def run_totals(spark, feed, folder, keys=("key",)):
    streams.start_visit_totals(source(spark, feed), list(keys), f"{folder}/totals", availableNow=True).awaitTermination()


def test_totals(spark, events, feed, tmp_path):
    run_totals(spark, feed, tmp_path)
    found = streams.read_visit_totals(events, ["key"], f"{tmp_path}/totals")
    assert same(found, events.groupBy("key").agg(F.count("*").alias("visits")))
    # The state is read, and nothing else is there to read.
    assert not list((tmp_path / "totals").rglob("*.parquet"))


def test_totals_continue_after_restart_and_replay(spark, events, feed, tmp_path):
    import os

    half = tmp_path / "feed"
    half.mkdir()
    early = events.filter("event_id < 900")
    for n in range(BATCHES):
        if n == 3:
            run_totals(spark, str(half), tmp_path)
            found = streams.read_visit_totals(events, ["key"], f"{tmp_path}/totals")
            assert same(found, early.groupBy("key").agg(F.count("*").alias("visits")))
        shutil.copy2(f"{feed}/{n}.parquet", half)
        os.utime(half / f"{n}.parquet", (1_000_000 + n, 1_000_000 + n))
    run_totals(spark, str(half), tmp_path)
    forget_last_batch(tmp_path / "totals")
    run_totals(spark, str(half), tmp_path)
    found = streams.read_visit_totals(events, ["key"], f"{tmp_path}/totals")
    assert same(found, events.groupBy("key").agg(F.count("*").alias("visits")))


def test_no_totals_before_the_first_batch(spark, events, tmp_path):
    (tmp_path / "feed").mkdir()
    run_totals(spark, str(tmp_path / "feed"), tmp_path)
    found = streams.read_visit_totals(events, ["key"], f"{tmp_path}/totals")
    assert found.columns == ["key", "visits"] and found.isEmpty()


def forget_last_batch(checkpoint):
    """As if the driver had died after the last batch was written and before it was marked as done."""
    for name in (str(BATCHES - 1), f".{BATCHES - 1}.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)


def test_state_gets_one_row_per_task_and_key(spark, feed, tmp_path):
    """A hot key is counted in the tasks before the state store sees it."""
    run_totals(spark, feed, tmp_path)
    query = streams.start_visit_ordinals(
        source(spark, feed), ["key"], ["ts", "event_id"], f"{tmp_path}/out", f"{tmp_path}/ck", availableNow=True
    )
    query.awaitTermination()
    for progress in query.recentProgress:
        updated = sum(operator["numRowsUpdated"] for operator in progress["stateOperators"])
        assert updated <= 22 < progress["numInputRows"]


@pytest.mark.parametrize("hot_key_rows", [50, 1_000_000], ids=["split", "window"])
def test_ordinals_and_repeated_batch(spark, feed, expected, tmp_path, hot_key_rows):
    run_ordinals(spark, feed, tmp_path, hot_key_rows)
    read = lambda: spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    assert same(read(), expected)
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == BATCHES
    forget_last_batch(tmp_path / "ck" / "stream")
    run_ordinals(spark, feed, tmp_path)
    assert same(read(), expected)


def test_ordinals_continue_after_restart(spark, feed, expected, tmp_path):
    import os

    half = tmp_path / "feed"
    half.mkdir()
    for n in range(BATCHES):
        if n == 4:
            run_ordinals(spark, str(half), tmp_path)
        shutil.copy2(f"{feed}/{n}.parquet", half)
        os.utime(half / f"{n}.parquet", (1_000_000 + n, 1_000_000 + n))
    run_ordinals(spark, str(half), tmp_path)
    assert same(spark.read.parquet(f"{tmp_path}/out").drop("batch_id"), expected)


def test_one_counter_for_all(spark, feed, events, tmp_path):
    query = streams.start_visit_ordinals(
        source(spark, feed), [], ["ts", "event_id"], f"{tmp_path}/out", f"{tmp_path}/ck", availableNow=True
    )
    query.awaitTermination()
    window = Window.orderBy(F.floor(F.col("event_id") / 300), "ts", "event_id")
    expected = events.withColumn("visit_no", F.row_number().over(window).cast("bigint"))
    assert same(spark.read.parquet(f"{tmp_path}/out").drop("batch_id"), expected)
    run_totals(spark, feed, tmp_path, [])
    assert streams.read_visit_totals(events, [], f"{tmp_path}/totals").first().visits == 2100


@pytest.mark.parametrize("timed", ["some", "none", "skewed"])
def test_the_stream_numbers_every_hit_of_a_table(spark, tmp_path, timed):
    i = F.col("id")
    at = F.timestamp_seconds(F.when(i == 0, 0).otherwise(9_000_000 + i) if timed == "skewed" else i * 7919 % 5000)
    known = F.lit(False) if timed == "none" else i % 4 != 1
    rows = spark.range(0, 600, 1, 4).select(
        i.alias("event_id"),
        F.when(known, at.cast("timestamp_ntz")).alias("ts"),
        F.when(i % 3 == 0, "hot").otherwise((i % 5).cast("string")).alias("event_type"),
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    found = plans.stream_visit_ordinal(spark, str(tmp_path))
    assert found.count() == 600
    assert same(found, plans.visit_ordinal(spark, str(tmp_path)))
    # A range is written by as many tasks as read it.
    assert all(part.rdd.getNumPartitions() > 1 for part in plans._ranges(spark.read.parquet(f"{tmp_path}/events.parquet")))
