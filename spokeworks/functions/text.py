"""Small text renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed wording of the visit counter.
COUNT_TEXT = "visitors to"
COUNT_PENDING = "Loading visitor count..."


def count_label(count: Column, site: str) -> Column:
    """'<n> visitors to <site>', or the pending text where the count is NULL."""
    known = F.concat(count.cast("string"), F.lit(f" {COUNT_TEXT} {site}"))
    return F.coalesce(known, F.lit(COUNT_PENDING))


def iso_instant(ts: Column) -> Column:
    """A UTC `timestamp_ntz` as yyyy-MM-ddTHH:mm:ss.SSSZ, cut to milliseconds.

    Works on the timestamp's own text, so the session time zone plays no part.
    """
    text = ts.cast("string")
    millis = F.rpad(F.substring(text, 21, 3), 3, "0")
    return F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), millis, F.lit("Z")
    )


def utc_instant(ts: Column) -> Column:
    """A `timestamp` as yyyy-MM-ddTHH:mm:ss.SSSZ in UTC, whatever the session's time zone."""
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return iso_instant(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds))


def with_iso_instant(df: DataFrame, ts: str, name: str) -> DataFrame:
    """Add column `name`: date-time column `ts` as an instant; `timestamp_ntz` and `date` count as UTC."""
    kind = df.schema[ts].dataType.typeName()
    text = utc_instant(F.col(ts)) if kind == "timestamp" else iso_instant(F.col(ts).cast("timestamp_ntz"))
    return df.withColumn(name, text)


def xml_escape(col: Column) -> Column:
    """The five XML entities, ampersand first."""
    for char, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&apos;"),
    ):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col
