"""Keyed record assembly and nested flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.operators import keyed, nested, urls
from spokeworks.sources import read_table

_MAX_ENTRIES = 4


def _page_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return urls.with_url_parts(read_table(spark, folder, "pages").select("page_id", "url"), "url")


def keyed_records(spark: SparkSession, folder: str) -> DataFrame:
    records = keyed.keyed_records(_page_hosts(spark, folder), "url", {"name": "host", "value": "path"})
    return records.select("key", "record.name", "record.value")


def non_apex_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages outside their site's apex host; here a site is a host without www., blog. or m."""
    apex = F.regexp_replace("host", r"^(www|blog|m)\.", "")
    hosts = _page_hosts(spark, folder)
    return hosts.filter(keyed.outside_apex(F.col("host"), apex)).select("page_id", "host")


def unique_key_map(spark: SparkSession, folder: str, max_entries: int | None = None) -> DataFrame:
    """All orders of a customer as order number -> status, printed as sorted text."""
    orders = read_table(spark, folder, "orders").select(
        "o_custkey", F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("value")
    )
    maps = keyed.unique_key_maps(orders, ["o_custkey"], "name", "value", max_entries)
    printed = F.array_join(
        F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )
    return maps.select("o_custkey", *(["part"] if max_entries else []), printed.alias("entries"))


def unique_key_map_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The same in parts of a few entries."""
    return unique_key_map(spark, folder, _MAX_ENTRIES)


def flatten_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a document as sections, their sentences as items."""

    def section(line):
        return F.struct(
            F.substring_index(line, " ", 1).alias("title"),
            F.filter(F.split(line, r"\. "), lambda item: item != "").alias("items"),
        )

    documents = read_table(spark, folder, "documents").select(
        "doc_id", F.transform(F.split("text", "\n"), section).alias("sections")
    )
    return nested.flatten_sections(documents)


QUERIES = {
    "keyed_records": keyed_records,
    "non_apex_hosts": non_apex_hosts,
    "unique_key_map": unique_key_map,
    "unique_key_map_parts": unique_key_map_parts,
    "flatten_sections": flatten_sections,
}

_HOST_SQL = """
WITH h AS (
  SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
"""

SQL = {
    "keyed_records": _HOST_SQL + "SELECT url AS key, host AS name, path AS value FROM h",
    "non_apex_hosts": _HOST_SQL
    + """SELECT page_id, host FROM (SELECT *, regexp_replace(host, '^(www|blog|m)\\.', '') AS apex FROM h)
WHERE host <> apex AND host <> 'www.' || apex""",
    "unique_key_map": """
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR) || '=' || o_orderstatus, ',' ORDER BY CAST(o_orderkey AS VARCHAR))
  AS entries
FROM orders GROUP BY o_custkey""",
    "unique_key_map_parts": f"""
WITH n AS (
  SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS name, o_orderstatus AS value,
    (row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) - 1) // {_MAX_ENTRIES} AS part
  FROM orders)
SELECT o_custkey, part, string_agg(name || '=' || value, ',' ORDER BY name) AS entries FROM n GROUP BY o_custkey, part
""",
    "flatten_sections": """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
sections AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS section_no, l[i] AS line
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM lines)),
split AS (
  SELECT doc_id, section_no, string_split(line, ' ')[1] AS title,
    list_filter(string_split(line, '. '), lambda x: x <> '') AS items
  FROM sections)
SELECT doc_id, section_no, title, CAST(i - 1 AS INTEGER) AS item_no, items[i] AS item
FROM (SELECT *, unnest(CASE WHEN len(items) = 0 THEN [NULL] ELSE range(1, len(items) + 1) END) AS i FROM split)
""",
}
