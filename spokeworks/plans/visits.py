"""Visit totals and ordinals over events, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.functions import count_label, iso_instant
from spokeworks.operators import counts
from spokeworks.operators.ordinal import add_ordinal
from spokeworks.sources import read_table, stream_table
from spokeworks.streaming import visits as streams
from spokeworks.workspace import scratch_path

_KEY = ["event_type"]
_ORDER = ["ts", "event_id"]
_SITE = "example.com"
_BATCHES = 3


def _hits(table: DataFrame) -> DataFrame:
    return table.select("event_id", "ts", "event_type")


def visit_total(spark: SparkSession, folder: str) -> DataFrame:
    return counts.visit_totals(read_table(spark, folder, "events"), _KEY)


def visit_total_site(spark: SparkSession, folder: str) -> DataFrame:
    return counts.visit_totals(read_table(spark, folder, "events"))


def visit_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    hits = _hits(read_table(spark, folder, "events"))
    return counts.visit_ordinals(hits, _KEY, _ORDER).select("event_id", "event_type", "visit_no")


def visit_ordinal_split(spark: SparkSession, folder: str) -> DataFrame:
    """Ordinals per key with a bound so small that every key is spread over tasks."""
    hits = _hits(read_table(spark, folder, "events"))
    return add_ordinal(hits, _ORDER, _KEY, "visit_no", hot_key_rows=10).select("event_id", "event_type", "visit_no")


def visit_ordinal_site(spark: SparkSession, folder: str) -> DataFrame:
    hits = _hits(read_table(spark, folder, "events")).drop("event_type")
    return counts.visit_ordinals(hits, [], _ORDER).select("event_id", "visit_no")


def count_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label per customer; those without a hit still show the pending text."""
    totals = counts.visit_totals(read_table(spark, folder, "events"), ["user_id"])
    customers = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    return customers.join(totals, "user_id", "left").select(
        "user_id", count_label(F.col("visits"), _SITE).alias("label")
    )


def iso_instants(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select("event_id", iso_instant(F.col("ts")).alias("instant"))


def _ranges(events: DataFrame) -> list[DataFrame]:
    """The hits cut into ranges of time, earliest first; hits without a time come first, as in the batch order."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(seconds), F.max(seconds)).first()
    if first is None:
        return [events]
    width = (last - first) // _BATCHES + 1
    place = F.coalesce(F.floor((seconds - F.lit(first)) / width), F.lit(0))
    return [events.filter(place == n) for n in range(_BATCHES)]


def stream_visit_total(spark: SparkSession, folder: str) -> DataFrame:
    work = scratch_path(spark, "stream-totals")
    events = stream_table(spark, folder, "events")
    streams.start_visit_totals(events, _KEY, work, availableNow=True).awaitTermination()
    return streams.read_visit_totals(events, _KEY, work)


def stream_visit_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """Ordinals over a stream that is fed a range of time at a time and takes each, of any number of files, as one batch."""
    work = scratch_path(spark, "stream-ordinals")
    events = _hits(read_table(spark, folder, "events"))
    for part in _ranges(events):
        part.write.mode("append").parquet(f"{work}/feed")
        hits = spark.readStream.schema(events.schema).parquet(f"{work}/feed")
        streams.start_visit_ordinals(
            hits, _KEY, _ORDER, f"{work}/out", f"{work}/checkpoint", availableNow=True
        ).awaitTermination()
    return spark.read.parquet(f"{work}/out").select("event_id", "event_type", "visit_no")


QUERIES = {
    "visit_total": visit_total,
    "visit_total_site": visit_total_site,
    "visit_ordinal": visit_ordinal,
    "visit_ordinal_site": visit_ordinal_site,
    "visit_ordinal_split": visit_ordinal_split,
    "count_label": count_labels,
    "iso_instant": iso_instants,
    "stream_visit_total": stream_visit_total,
    "stream_visit_ordinal": stream_visit_ordinal,
}

_TOTAL_SQL = "SELECT event_type, count(*) AS visits FROM events GROUP BY event_type"
_ORDINAL_SQL = """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS visit_no
FROM events"""

SQL = {
    "visit_total": _TOTAL_SQL,
    "visit_total_site": "SELECT count(*) AS visits FROM events",
    "visit_ordinal": _ORDINAL_SQL,
    "visit_ordinal_split": _ORDINAL_SQL,
    "visit_ordinal_site": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS visit_no FROM events",
    "count_label": """
SELECT c_custkey AS user_id,
  COALESCE(CAST(n AS VARCHAR) || ' visitors to example.com', 'Loading visitor count...') AS label
FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) t ON user_id = c_custkey""",
    "iso_instant": """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z'
  AS instant
FROM events""",
    "stream_visit_total": _TOTAL_SQL,
    "stream_visit_ordinal": _ORDINAL_SQL,
}
