"""URL canonicalisation over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeworks.functions import trailing_slash, url_host, url_path, url_query


def with_url_parts(df: DataFrame, url: str) -> DataFrame:
    """Add `host`, `path` and `query` ('?' included) of http(s) URLs; the fragment is dropped.

    All three are '' for anything else.
    """
    whole = F.col(url)
    return df.withColumns({"host": url_host(whole), "path": url_path(whole), "query": url_query(whole)})


def fold_host(host: Column, apex: Column | None = None, prefer: str = "www") -> Column:
    """Map {apex, www.apex} to the preferred one; other hosts pass through.

    Without `apex` every host is folded with its own twin.
    """
    if prefer not in ("www", "bare"):
        raise ValueError("prefer is 'www' or 'bare'")
    if apex is not None:
        pair = (host == apex) | (host == F.concat(F.lit("www."), apex))
        return F.when(pair, F.concat(F.lit("www." if prefer == "www" else ""), apex)).otherwise(host)
    has_www = F.startswith(host, F.lit("www."))
    if prefer == "bare":
        return F.when(has_www, F.substr(host, F.lit(5))).otherwise(host)
    return F.when(has_www | (host == ""), host).otherwise(F.concat(F.lit("www."), host))


def _with_canonical_parts(df: DataFrame, url: str, apex: Column | None, prefer: str) -> DataFrame:
    return with_url_parts(df, url).withColumns(
        {"host": fold_host(F.col("host"), apex, prefer), "path": trailing_slash(F.col("path"))}
    )


def _joined() -> Column:
    return F.concat(F.lit("https://"), F.col("host"), F.col("path"), F.col("query"))


def with_canonical_url(
    df: DataFrame, url: str, name: str = "canonical_url", apex: Column | None = None, prefer: str = "www"
) -> DataFrame:
    """Add the https form with folded host, trailing slash, query kept and no fragment.

    Adds its `host`, `path` and `query`, too. What is no http(s) URL stays as it
    is, with an empty host.
    """
    parts = _with_canonical_parts(df, url, apex, prefer)
    return parts.withColumn(name, F.when(F.col("host") == "", F.col(url)).otherwise(_joined()))


def distinct_locations(
    df: DataFrame, url: str, name: str = "loc", apex: Column | None = None, prefer: str = "www"
) -> DataFrame:
    """Distinct canonical forms of all http(s) URLs, with their parts.

    The parts are deduplicated and joined afterwards, so nothing is parsed twice.
    """
    parts = _with_canonical_parts(df, url, apex, prefer).select("host", "path", "query")
    # The host of anything else is '', folded or not; filtering after the distinct keeps it from being parsed twice.
    return parts.distinct().filter("host <> ''").withColumn(name, _joined())
