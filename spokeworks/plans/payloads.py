"""Payload extraction and contract gate over event properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.functions import parsed_field
from spokeworks.operators import contract
from spokeworks.sources import read_payloads, read_table
from spokeworks.workspace import scratch_path

_FIELD = "k"


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties as responses, some of them damaged in every way the gate tells apart."""
    i, props = F.col("event_id"), F.col("props")
    digits = r"([0-9]+)"
    body = (
        F.when(i % 13 == 0, F.rtrim(props, F.lit("}")))
        .when(i % 17 == 0, F.replace(props, F.lit('"k"'), F.lit('"j"')))
        .when(i % 19 == 0, F.regexp_replace(props, digits, '"$1"'))
        .when(i % 23 == 0, F.regexp_replace(props, digits, "null"))
        .when(i % 29 == 0, F.regexp_replace(props, digits, "$1.5"))
        .when(i % 31 == 0, F.concat(props, F.lit(" x")))
        .when(i % 37 == 0, F.regexp_replace(props, digits, "[$1]"))
        .when(i % 41 == 0, F.concat(F.lit('{"k": 7, "j": 1, "j": 2, '), F.substr(props, F.lit(2))))
        .otherwise(props)
    )
    status = F.when(i % 11 == 0, 500).otherwise(200)
    return read_table(spark, folder, "events").select("event_id", status.alias("status"), body.alias("body"))


def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    return contract.with_json_field(payloads(spark, folder), _FIELD, "double").select("event_id", "k")


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return contract.check_payloads(payloads(spark, folder), _FIELD)


def json_contract(spark: SparkSession, folder: str) -> DataFrame:
    return contract.verdict_counts(_checked(spark, folder))


def json_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return contract.quarantined(_checked(spark, folder)).select("event_id", "status", "body", "verdict")


def json_gated(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads written in one pass, a folder per verdict, and read back."""
    path = scratch_path(spark, "gated")
    contract.write_gated(_checked(spark, folder), path)
    return spark.read.parquet(path).select("event_id", "status", "body", "verdict")


def payload_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies written one per line, read back as text and gated: verdict and body of each."""
    path = scratch_path(spark, "lines")
    payloads(spark, folder).select(F.col("body").alias("value")).write.text(path)
    read = read_payloads(spark, path).withColumn("status", F.lit(200))
    return contract.check_payloads(read, _FIELD).select("body", "verdict")


def json_passing(spark: SparkSession, folder: str) -> DataFrame:
    return contract.passing(_checked(spark, folder)).select("event_id", "body")


def json_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Fields and verdicts of payloads that were parsed once, stored in parsed form and read back."""
    path = scratch_path(spark, "parsed")
    contract.write_parsed(contract.parse_payloads(payloads(spark, folder), _FIELD), path)
    k = parsed_field(F.col("doc"), _FIELD, "double")
    return spark.read.parquet(path).select("event_id", "status", "verdict", k.alias("k"))


QUERIES = {
    "json_field": json_fields,
    "json_contract": json_contract,
    "json_quarantine": json_quarantine,
    "json_passing": json_passing,
    "json_gated": json_gated,
    "payload_lines": payload_lines,
    "json_stored": json_stored,
}

_PAYLOAD_SQL = """
WITH p AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 500 ELSE 200 END AS status,
    CASE WHEN event_id % 13 = 0 THEN rtrim(props, '}')
         WHEN event_id % 17 = 0 THEN replace(props, '"k"', '"j"')
         WHEN event_id % 19 = 0 THEN regexp_replace(props, '([0-9]+)', '"\\1"')
         WHEN event_id % 23 = 0 THEN regexp_replace(props, '([0-9]+)', 'null')
         WHEN event_id % 29 = 0 THEN regexp_replace(props, '([0-9]+)', '\\1.5')
         WHEN event_id % 31 = 0 THEN props || ' x'
         WHEN event_id % 37 = 0 THEN regexp_replace(props, '([0-9]+)', '[\\1]')
         WHEN event_id % 41 = 0 THEN '{"k": 7, "j": 1, "j": 2, ' || substr(props, 2)
         ELSE props END AS body
  FROM events),
typed AS (
  SELECT *, json_valid(body) AS ok,
    -- the last of a repeated key counts
    CASE WHEN json_valid(body) THEN replace(body, '{"k": 7, "j": 1, "j": 2, ', '{') END AS doc
  FROM p),
checked AS (
  SELECT event_id, status, body, doc,
    CASE WHEN status <> 200 THEN 'bad_status'
         WHEN NOT ok THEN 'unparseable'
         WHEN json_type(doc, '$.k') IS NULL THEN 'missing'
         WHEN json_type(doc, '$.k') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'not_numeric'
         ELSE 'pass' END AS verdict
  FROM typed)
"""

SQL = {
    "json_field": _PAYLOAD_SQL
    + "SELECT event_id, TRY_CAST(json_extract_string(doc, '$.k') AS DOUBLE) AS k FROM checked",
    "json_stored": _PAYLOAD_SQL
    + "SELECT event_id, status, verdict, TRY_CAST(json_extract_string(doc, '$.k') AS DOUBLE) AS k FROM checked",
    "json_contract": _PAYLOAD_SQL
    + "SELECT verdict, count(*) AS payloads FROM checked GROUP BY verdict",
    "json_quarantine": _PAYLOAD_SQL
    + "SELECT event_id, status, body, verdict FROM checked WHERE verdict <> 'pass'",
    "json_passing": _PAYLOAD_SQL + "SELECT event_id, body FROM checked WHERE verdict = 'pass'",
    "json_gated": _PAYLOAD_SQL + "SELECT event_id, status, body, verdict FROM checked",
    "payload_lines": _PAYLOAD_SQL.replace("THEN 500 ELSE 200", "THEN 200 ELSE 200")
    + "SELECT body, verdict FROM checked",
}
