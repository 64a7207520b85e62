"""Contract gate for JSON payload tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.functions import contract_verdict, json_field, keep_last_key, parsed_body, parsed_verdict, strict_json


def check_payloads(payloads: DataFrame, field: str, status: str = "status", body: str = "body") -> DataFrame:
    """Add `verdict`: 'pass', 'bad_status', 'unparseable', 'missing' or 'not_numeric'.

    A key that an object repeats has its last value. The verdict is generated
    rather than projected, so that a filter on it does not compute it again.
    """
    verdict = contract_verdict(F.col(status), F.col(body), field)
    with keep_last_key(payloads.sparkSession):
        return payloads.select("*", F.inline(F.array(F.struct(verdict.alias("verdict")))))


def with_json_field(payloads: DataFrame, field: str, as_type: str, name: str | None = None, body: str = "body") -> DataFrame:
    """Add top-level `field` as `as_type`; NULL for broken payloads and missing fields, the last of a repeated key."""
    with keep_last_key(payloads.sparkSession):
        return payloads.withColumn(name or field, json_field(F.col(body), field, as_type))


def passing(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("verdict") == "pass").drop("verdict")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("verdict") != "pass")


def verdict_counts(checked: DataFrame) -> DataFrame:
    """Payloads per verdict."""
    return checked.groupBy("verdict").agg(F.count("*").alias("payloads"))


def write_gated(checked: DataFrame, path: str) -> None:
    """Write all payloads in one pass, in a folder per verdict; `verdict=pass` is the good set."""
    checked.write.partitionBy("verdict").parquet(path)


# Frequent fields of a variant become Parquet columns of their own, which a reader of one field reads alone.
_SHREDDING = ("spark.sql.variant.writeShredding.enabled", "spark.sql.variant.inferShreddingSchema")


@contextmanager
def _shredded(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in _SHREDDING}
    try:
        for name in _SHREDDING:
            spark.conf.set(name, "true")
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def parse_payloads(payloads: DataFrame, field: str, status: str = "status", body: str = "body") -> DataFrame:
    """Replace the text by `doc`, its parsed form as a variant, and add the `verdict` of `check_payloads`.

    The text is parsed once for both. `doc` is NULL where the text is not one JSON value.
    """
    with keep_last_key(payloads.sparkSession):
        # Generated rather than projected, so that what uses it does not parse again.
        parsed = payloads.select("*", F.inline(F.array(F.struct(strict_json(F.col(body)).alias("_parsed")))))
    columns = [c for c in payloads.columns if c != body]
    verdict = parsed_verdict(F.col(status), F.col("_parsed"), field)
    return parsed.select(*columns, parsed_body(F.col("_parsed")).alias("doc"), verdict.alias("verdict"))


def write_parsed(parsed: DataFrame, path: str) -> None:
    """Write parsed payloads as Parquet; readers take fields with `parsed_field` and parse nothing."""
    with _shredded(parsed.sparkSession):
        parsed.write.parquet(path)
