"""Sitemap entries, shards and index over page tables of many hosts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeworks.functions import with_iso_instant, xml_escape
from spokeworks.operators.joins import MAX_BROADCAST_ROWS, bounded_table, lookup_join
from spokeworks.operators.ordinal import add_ordinal
from spokeworks.operators.urls import distinct_locations

# Fixed values of the sitemap settings.
SITEMAP_SIZE = 5000
CHANGEFREQ = "weekly"
PRIORITY = 0.7


def page_locations(
    pages: DataFrame, url: str = "url", apex: Column | None = None, prefer: str = "www"
) -> DataFrame:
    """Distinct canonical locations with their host and path."""
    return distinct_locations(pages, url, "loc", apex, prefer)


def _page(path: Column) -> Column:
    return F.rtrim(path, F.lit("/"))


def exclude_paths(locations: DataFrame, excluded: Sequence[str] | DataFrame) -> DataFrame:
    """Drop locations whose exact path is listed; a trailing slash makes no difference.

    A short list becomes a filter, a longer one a table. A DataFrame with
    column `path` may be of any size. All forms give the same rows.
    """
    if not isinstance(excluded, DataFrame) and len(excluded) > MAX_BROADCAST_ROWS:
        excluded = bounded_table(locations.sparkSession, {"path": (pa.string(), excluded)})
    if isinstance(excluded, DataFrame):
        listed = excluded.select(_page(F.col("path")).alias("_page")).distinct()
        return lookup_join(
            locations.withColumn("_page", _page(F.col("path"))), listed, ["_page"], "left_anti"
        ).drop("_page")
    return locations.filter(~_page(F.col("path")).isin([path.rstrip("/") for path in excluded]))


def build_stamp(text: str) -> str:
    """An ISO date-time as stamp text in UTC; one without an offset is UTC already."""
    moment = datetime.fromisoformat(text)
    moment = moment.astimezone(UTC) if moment.tzinfo else moment
    return f"{moment:%Y-%m-%dT%H:%M:%S}.{moment.microsecond // 1000:03d}Z"


def with_sitemap_fields(
    locations: DataFrame,
    build_time: str | None = None,
    changefreq: str = CHANGEFREQ,
    priority: float = PRIORITY,
    lastmod: str | None = None,
) -> DataFrame:
    """(host, loc, lastmod, changefreq, priority).

    `lastmod` names a date-time column with each page's own stamp; where it is
    NULL, or without it, the page gets `build_time`. Without either the stamp
    is NULL, which leaves the element out.
    """
    stamp = F.lit(build_stamp(build_time) if build_time else None).cast("string")
    if lastmod is not None:
        locations = with_iso_instant(locations, lastmod, "_stamp")
        stamp = F.coalesce(F.col("_stamp"), stamp)
    return locations.select(
        "host",
        "loc",
        stamp.alias("lastmod"),
        F.lit(changefreq).alias("changefreq"),
        F.lit(float(priority)).alias("priority"),
    )


def with_shard(entries: DataFrame, size: int = SITEMAP_SIZE, per_host: bool = True) -> DataFrame:
    """Number the entries by ascending location and cut them into shards of `size`.

    Per host the entries are read more than once, so pass a table (`scratch_table`).
    """
    numbered = add_ordinal(entries, ["loc"], ["host"] if per_host else [], "_no")
    return numbered.withColumn("shard", F.call_function("div", F.col("_no") - 1, F.lit(size))).drop("_no")


def sitemap_index(entries: DataFrame, size: int = SITEMAP_SIZE) -> DataFrame:
    """One row per shard file of every host, from the entry counts alone."""
    last = F.call_function("div", F.col("_n") - 1, F.lit(size))
    return (
        entries.groupBy("host")
        .agg(F.count("*").alias("_n"))
        .select("host", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("shard"))
        .withColumn("loc", F.concat(F.lit("https://"), F.col("host"), F.lit("/"), shard_file(F.col("shard"))))
    )


def shard_file(shard: Column) -> Column:
    return F.concat(F.lit("sitemap-"), shard.cast("string"), F.lit(".xml"))


def _element(tag: str, text: Column) -> Column:
    """`<tag>text</tag>`, nothing for NULL."""
    return F.coalesce(F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>")), F.lit(""))


def url_element(loc: Column, lastmod: Column, changefreq: Column, priority: Column) -> Column:
    """One `<url>` line; fields that are NULL are left out, a whole priority has no decimals."""
    return F.concat(
        F.lit("<url>"),
        _element("loc", xml_escape(loc)),
        _element("lastmod", lastmod),
        _element("changefreq", changefreq),
        _element("priority", F.regexp_replace(priority.cast("string"), r"\.0$", "")),
        F.lit("</url>"),
    )


def index_element(loc: Column) -> Column:
    """One `<sitemap>` line."""
    return F.concat(F.lit("<sitemap><loc>"), xml_escape(loc), F.lit("</loc></sitemap>"))
