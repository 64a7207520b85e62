"""Sitemap jobs over crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.operators import sitemap
from spokeworks.plans.web import CANONICAL_SQL, canonical_pages
from spokeworks.sources import (
    publish_index,
    publish_robots,
    publish_site,
    publish_sitemaps,
    read_published_sitemaps,
    read_sitemap,
    read_table,
    write_sitemap_xml,
)
from spokeworks.workspace import scratch_path, scratch_table

_BUILD_TIME = "2025-01-31 08:05:09.070"
_STAMP = "2025-01-31T08:05:09.070Z"
# Small shards, so that the test tables fill more than one.
_HOST_SIZE = 20
_SITE_SIZE = 40
_SPAM = "(pills|spam)"
_LISTED = ("/", "/blog/", "/index.html", "/about")


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    """Locations on paths that no spam host uses."""
    locations = sitemap.page_locations(read_table(spark, folder, "pages"), prefer="bare")
    spam = canonical_pages(spark, folder).filter(F.regexp_like("host", F.lit(_SPAM)))
    return sitemap.exclude_paths(locations, spam)


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return sitemap.with_sitemap_fields(_kept(spark, folder), _BUILD_TIME)


def _host_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sitemap.with_shard(scratch_table(_entries(spark, folder), "entries"), _HOST_SIZE)


def sitemap_exclude(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder).select("loc")


def sitemap_entries(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(spark, folder).select("loc", "lastmod", "changefreq", "priority")


def sitemap_shards(spark: SparkSession, folder: str) -> DataFrame:
    return _host_shards(spark, folder).select("host", "shard", "loc")


def sitemap_shards_site(spark: SparkSession, folder: str) -> DataFrame:
    return sitemap.with_shard(_entries(spark, folder), _SITE_SIZE, per_host=False).select("shard", "loc")


def sitemap_index(spark: SparkSession, folder: str) -> DataFrame:
    return sitemap.sitemap_index(_entries(spark, folder), _HOST_SIZE).select("loc")


def sitemap_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Entries read back from the XML data set, with the folder they came from."""
    path = scratch_path(spark, "sitemap-xml")
    write_sitemap_xml(_host_shards(spark, folder), path)
    return read_sitemap(spark, path, partitioned=True).drop("source_file")


def _published_lines(spark: SparkSession, root: str) -> DataFrame:
    # The public layout is <host>/<name>.
    name = F.substring_index(F.input_file_name(), "/", -2)
    text = spark.read.option("recursiveFileLookup", True).text(root)
    return text.select(name.alias("file"), F.col("value").alias("line"))


def sitemap_publish(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all published sitemap files."""
    root = scratch_path(spark, "sitemap-files")
    publish_sitemaps(_host_shards(spark, folder), root)
    return _published_lines(spark, root)


def sitemap_publish_index(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all published index files."""
    root = scratch_path(spark, "index-files")
    publish_index(_entries(spark, folder), root, _HOST_SIZE)
    return _published_lines(spark, root)


def site_publish(spark: SparkSession, folder: str) -> DataFrame:
    """Files and line counts after a whole site was published, then again without its bare-www hosts' spam."""
    root = scratch_path(spark, "site-files")
    entries = _entries(spark, folder)
    everything = sitemap.with_sitemap_fields(
        sitemap.page_locations(read_table(spark, folder, "pages"), prefer="bare"), _BUILD_TIME
    )
    publish_site(everything, root, _HOST_SIZE)
    publish_site(entries, root, _HOST_SIZE)
    return _published_lines(spark, root).groupBy("file").agg(F.count("*").alias("lines"))


def sitemap_reread(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of a published site, read back through the index of every host."""
    root = scratch_path(spark, "reread-files")
    publish_site(_entries(spark, folder), root, _HOST_SIZE)
    return read_published_sitemaps(spark, root)


def sitemap_exclude_list(spark: SparkSession, folder: str) -> DataFrame:
    """Locations whose path is not in a list."""
    locations = sitemap.page_locations(read_table(spark, folder, "pages"), prefer="bare")
    return sitemap.exclude_paths(locations, _LISTED).select("loc")


def sitemap_lastmod(spark: SparkSession, folder: str) -> DataFrame:
    """Entries with a stamp per page, by the length of its path; long ones take the build's."""
    locations = _kept(spark, folder)
    size = F.length("path")
    moment = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=size)
    dated = locations.withColumn("changed", F.when(size < 20, moment))
    entries = sitemap.with_sitemap_fields(dated, "2025-01-31T10:05:09.070+02:00", lastmod="changed")
    return entries.select("loc", "lastmod")


def robots_txt(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all published robots.txt files."""
    root = scratch_path(spark, "robots-files")
    publish_robots(_entries(spark, folder), root)
    return _published_lines(spark, root)


QUERIES = {
    "sitemap_exclude": sitemap_exclude,
    "sitemap_entries": sitemap_entries,
    "sitemap_shards": sitemap_shards,
    "sitemap_shards_site": sitemap_shards_site,
    "sitemap_index": sitemap_index,
    "sitemap_roundtrip": sitemap_roundtrip,
    "sitemap_publish": sitemap_publish,
    "sitemap_publish_index": sitemap_publish_index,
    "robots_txt": robots_txt,
    "site_publish": site_publish,
    "sitemap_reread": sitemap_reread,
    "sitemap_exclude_list": sitemap_exclude_list,
    "sitemap_lastmod": sitemap_lastmod,
}

_ENTRY_SQL = (
    CANONICAL_SQL
    + f""", uniq AS (SELECT DISTINCT host, rtrim(path, '/') AS page, loc FROM located),
kept AS (
  SELECT host, loc FROM uniq
  WHERE page NOT IN (SELECT page FROM uniq WHERE regexp_matches(host, '{_SPAM}'))),
entries AS (
  SELECT host, loc, '{_STAMP}' AS lastmod, 'weekly' AS changefreq, CAST(0.7 AS DOUBLE) AS priority FROM kept),
sharded AS (
  SELECT *, (row_number() OVER (PARTITION BY host ORDER BY loc) - 1) // {_HOST_SIZE} AS shard FROM entries),
files AS (SELECT DISTINCT host, shard FROM sharded)
"""
)

# Fixed lines of the sitemap documents and of robots.txt.
_URLSET_LINE = (
    '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    ' xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"'
    ' xmlns:xhtml="http://www.w3.org/1999/xhtml"'
    ' xmlns:mobile="http://www.google.com/schemas/sitemap-mobile/1.0"'
    ' xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"'
    ' xmlns:video="http://www.google.com/schemas/sitemap-video/1.1">'
)
_DECLARATION_LINE = '<?xml version="1.0" encoding="UTF-8"?>'

SQL = {
    "sitemap_exclude": _ENTRY_SQL + "SELECT loc FROM kept",
    "sitemap_entries": _ENTRY_SQL + "SELECT loc, lastmod, changefreq, priority FROM entries",
    "sitemap_shards": _ENTRY_SQL + "SELECT host, shard, loc FROM sharded",
    "sitemap_shards_site": _ENTRY_SQL
    + f"SELECT (row_number() OVER (ORDER BY loc) - 1) // {_SITE_SIZE} AS shard, loc FROM entries",
    "sitemap_index": _ENTRY_SQL + "SELECT 'https://' || host || '/sitemap-' || shard || '.xml' AS loc FROM files",
    "sitemap_roundtrip": _ENTRY_SQL + "SELECT host, shard, loc, lastmod, changefreq, priority FROM sharded",
    "sitemap_publish": _ENTRY_SQL
    + f"""
SELECT host || '/sitemap-' || shard || '.xml' AS file,
  '<url><loc>' || replace(loc, '&', '&amp;') || '</loc><lastmod>' || lastmod || '</lastmod><changefreq>'
  || changefreq || '</changefreq><priority>0.7</priority></url>' AS line
FROM sharded
UNION ALL
SELECT host || '/sitemap-' || shard || '.xml', unnest(['{_DECLARATION_LINE}', '{_URLSET_LINE}', '</urlset>'])
FROM files""",
    "sitemap_publish_index": _ENTRY_SQL
    + f"""
SELECT host || '/sitemap.xml' AS file,
  '<sitemap><loc>https://' || host || '/sitemap-' || shard || '.xml</loc></sitemap>' AS line
FROM files
UNION ALL
SELECT host || '/sitemap.xml', unnest(['{_DECLARATION_LINE}',
  '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', '</sitemapindex>'])
FROM (SELECT DISTINCT host FROM files)""",
    "site_publish": _ENTRY_SQL
    + """
SELECT host || '/sitemap-' || shard || '.xml' AS file, count(*) + 3 AS lines FROM sharded GROUP BY host, shard
UNION ALL SELECT host || '/sitemap.xml', count(*) + 3 FROM files GROUP BY host
UNION ALL SELECT DISTINCT host || '/robots.txt', 9 FROM files""",
    "sitemap_reread": _ENTRY_SQL
    + "SELECT host, 'sitemap-' || shard || '.xml' AS file, loc, lastmod, changefreq, priority FROM sharded",
    "sitemap_exclude_list": _ENTRY_SQL
    + "SELECT loc FROM uniq WHERE page NOT IN ('', '/blog', '/index.html', '/about')",
    "sitemap_lastmod": _ENTRY_SQL
    + f"""
SELECT loc, coalesce(CASE WHEN length(path) < 20 THEN
    strftime(TIMESTAMP '2025-01-01' + to_days(CAST(length(path) AS INTEGER)), '%Y-%m-%dT%H:%M:%S.000Z') END, '{_STAMP}') AS lastmod
FROM (SELECT DISTINCT host, path, loc FROM located) JOIN kept USING (host, loc)""",
    "robots_txt": _ENTRY_SQL
    + """
SELECT host || '/robots.txt' AS file, unnest(['# *', 'User-agent: *', 'Allow: /', '', '# Host',
  'Host: https://' || host, '', '# Sitemaps', 'Sitemap: https://' || host || '/sitemap.xml']) AS line
FROM (SELECT DISTINCT host FROM files)""",
}
