"""URL canonicalisation, object keys, content types and routes over crawled pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.functions import object_key
from spokeworks.operators import routing, urls
from spokeworks.sources import read_table
from spokeworks.workspace import scratch_path, shuffle_partitions

# Buckets of the stored objects, at least.
_BUCKETS = 8
_HREF = 'href="([^"]*)"'


def canonical_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    return urls.with_canonical_url(pages, "url", prefer="bare")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests a page gives rise to: itself, as linked from outside, and every link in it."""
    pages = urls.with_url_parts(read_table(spark, folder, "pages").select("page_id", "url", "html"), "url")
    links = F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))
    asked = pages.select(
        "page_id",
        urls.fold_host(F.col("host"), prefer="bare").alias("host"),
        F.posexplode(F.concat(F.array("path"), links)).alias("link_no", "path"),
    )
    return asked.withColumn("object_key", object_key(F.col("path")))


def stored_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Objects a site holds: one per canonical page path."""
    return canonical_pages(spark, folder).select("host", object_key(F.col("path")).alias("object_key"))


def canonical_url(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_pages(spark, folder).select("page_id", "canonical_url")


def object_keys(spark: SparkSession, folder: str) -> DataFrame:
    return requests(spark, folder).select("page_id", "link_no", "object_key")


def content_type_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return routing.with_content_type(object_keys(spark, folder)).select("page_id", "link_no", "content_type")


def route_resolve(spark: SparkSession, folder: str) -> DataFrame:
    routed = routing.resolve_routes(requests(spark, folder), stored_objects(spark, folder), scope=["host"])
    return routed.select("page_id", "link_no", "found", "served_key")


def route_resolve_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The same routes against objects that are kept in buckets."""
    name = f"route_objects_{uuid.uuid4().hex}"
    buckets = max(_BUCKETS, shuffle_partitions(spark))
    routing.store_objects(stored_objects(spark, folder), name, buckets, scope=["host"], path=scratch_path(spark, name))
    routed = routing.resolve_stored_routes(requests(spark, folder), name, scope=["host"])
    return routed.select("page_id", "link_no", "found", "served_key")


QUERIES = {
    "canonical_url": canonical_url,
    "object_key": object_keys,
    "content_type_lookup": content_type_lookup,
    "route_resolve": route_resolve,
    "route_resolve_stored": route_resolve_stored,
}

CANONICAL_SQL = """
WITH parts AS (
  SELECT page_id, url, html,
    regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') AS host,
    regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS raw_path,
    regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS query
  FROM pages),
canon AS (
  SELECT *, CASE WHEN raw_path = '' THEN '/' WHEN regexp_matches(raw_path, '/[^/.]+$') THEN raw_path || '/'
    ELSE raw_path END AS path
  FROM parts),
located AS (SELECT *, 'https://' || host || path || query AS loc FROM canon)
"""

_ROUTE_SQL = (
    CANONICAL_SQL
    + """, links AS (
  SELECT page_id, host, list_concat([raw_path], regexp_extract_all(html, 'href="([^"]*)"', 1)) AS paths FROM located),
asked AS (
  SELECT page_id, host, CAST(i - 1 AS INTEGER) AS link_no, paths[i] AS path
  FROM (SELECT *, unnest(range(1, len(paths) + 1)) AS i FROM links)),
keyed AS (
  SELECT page_id, host, link_no,
    CASE WHEN regexp_matches(path, '(^|/)$') THEN ltrim_one || 'index.html' ELSE ltrim_one END AS object_key
  FROM (SELECT *, regexp_replace(path, '^/', '') AS ltrim_one FROM asked)),
stored AS (
  SELECT DISTINCT host, regexp_replace(CASE WHEN path LIKE '%/' THEN path || 'index.html' ELSE path END, '^/', '')
    AS object_key
  FROM located)
"""
)

_RESOLVE_SQL = (
    _ROUTE_SQL
    + """SELECT page_id, link_no, s.object_key IS NOT NULL AS found,
  COALESCE(s.object_key, 'error.html') AS served_key
FROM keyed k LEFT JOIN stored s ON s.host = k.host AND s.object_key = k.object_key"""
)

SQL = {
    "canonical_url": CANONICAL_SQL + "SELECT page_id, loc AS canonical_url FROM located",
    "object_key": _ROUTE_SQL + "SELECT page_id, link_no, object_key FROM keyed",
    "content_type_lookup": _ROUTE_SQL
    + """SELECT page_id, link_no, CASE regexp_extract(object_key, '\\.[A-Za-z0-9]+$')
  WHEN '.html' THEN 'text/html' WHEN '.css' THEN 'text/css' WHEN '.js' THEN 'text/javascript' END AS content_type
FROM keyed""",
    "route_resolve": _RESOLVE_SQL,
    "route_resolve_stored": _RESOLVE_SQL,
}
