"""Sitemap sinks: a partitioned XML data set, and files under their public names."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.operators.sitemap import (
    SITEMAP_SIZE,
    index_element,
    shard_file,
    sitemap_index,
    url_element,
    with_shard,
)
from spokeworks.sources.filesink import published_lists, write_public_files
from spokeworks.workspace import scratch_table, shuffle_partitions, store_uri

# Fixed values of the sitemap documents.
XML_DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'
PLAIN_URLSET = 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
URLSET = (
    f"{PLAIN_URLSET}"
    ' xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"'
    ' xmlns:xhtml="http://www.w3.org/1999/xhtml"'
    ' xmlns:mobile="http://www.google.com/schemas/sitemap-mobile/1.0"'
    ' xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"'
    ' xmlns:video="http://www.google.com/schemas/sitemap-video/1.1"'
)
SITEMAP_INDEX = 'sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
# Fixed lines of robots.txt: the default policy, and what stands around the site's address.
ROBOTS_POLICIES = (("*", ("/",), ()),)
ROBOTS_HOST = "# Host\nHost: "
ROBOTS_SITEMAP = "\n\n# Sitemaps\nSitemap: "


def write_sitemap_xml(shards: DataFrame, path: str) -> None:
    """`host=.../shard=N/` with one XML file per shard, through Spark's own XML writer.

    That writer takes no prefixed attributes, so only the default namespace is declared.
    """
    # A fixed number of tasks: the work lies in the files, and AQE would merge tasks by bytes.
    tasks = shuffle_partitions(shards.sparkSession)
    (
        shards.repartition(tasks, "host", "shard")
        .sortWithinPartitions("host", "shard", "loc")
        .select("host", "shard", "loc", "lastmod", "changefreq", "priority")
        .write.partitionBy("host", "shard")
        .format("xml")
        .option("rootTag", PLAIN_URLSET)
        .option("rowTag", "url")
        .option("declaration", XML_DECLARATION.removeprefix("<?xml ").removesuffix("?>"))
        .save(path)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below `path`."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    return [status.getPath().getName() for status in store.listStatus(where) if status.isDirectory()]


def _publish(lines: DataFrame, root: str, documents: dict[str, tuple[str, str]]) -> DataFrame:
    """Write (kind, file, seq, line) rows as files; returns the files with their line counts.

    One job writes all of them. What earlier publications of these kinds wrote
    and this one did not is removed by a second one, from the lists that lie beside the
    public folder.
    """
    spark, job = lines.sparkSession, uuid.uuid4().hex
    root = root.rstrip("/")
    lists, uri = published_lists(root), store_uri(spark, root)
    earlier = {kind: _folders(spark, f"{lists}/kind={kind}") for kind in documents}
    placed = lines.repartition(shuffle_partitions(spark), "file").sortWithinPartitions("file", "seq")
    write_public_files(placed, uri, job, documents)

    def listed(paths: list[str]) -> DataFrame:
        found = [path for path in paths if _exists(spark, path)]
        return spark.read.schema("file string, lines bigint").option("escape", '"').csv(found) if found else spark.createDataFrame([], "file string, lines bigint")

    now = listed([f"{lists}/kind={kind}/job={job}" for kind in documents])
    before = [f"kind={kind}/{folder}" for kind, folders in earlier.items() for folder in folders]
    if before:
        gone = listed([f"{lists}/{path}" for path in before]).select("file").distinct().join(now, "file", "left_anti")
        removals = gone.select(F.lit("").alias("kind"), "file", F.lit(None).cast("string").alias("line"))
        write_public_files(removals, uri, f"{job}-removals", drop_lists=before)
    return now


def _document(tag: str) -> tuple[str, str]:
    return f"{XML_DECLARATION}\n<{tag}>\n", f"</{tag.split(' ', 1)[0]}>"


def _lines(rows: DataFrame, kind: str, name: Column, seq: Column, line: Column) -> DataFrame:
    file = F.concat("host", F.lit("/"), name)
    return rows.select(F.lit(kind).alias("kind"), file.alias("file"), seq.alias("seq"), line.alias("line"))


def _sitemap_lines(shards: DataFrame) -> DataFrame:
    line = url_element(F.col("loc"), F.col("lastmod"), F.col("changefreq"), F.col("priority"))
    return _lines(shards, "sitemaps", shard_file(F.col("shard")), F.col("loc"), line)


def _index_lines(entries: DataFrame, size: int) -> DataFrame:
    # Padded, so that texts sort as the numbers do.
    seq = F.lpad(F.col("shard").cast("string"), 19, "0")
    return _lines(sitemap_index(entries, size), "index", F.lit("sitemap.xml"), seq, index_element(F.col("loc")))


def publish_sitemaps(shards: DataFrame, root: str) -> DataFrame:
    """Write `<host>/sitemap-N.xml` below the path or URI `root`, entries in ascending order."""
    return _publish(_sitemap_lines(shards), root, {"sitemaps": _document(URLSET)})


def publish_index(entries: DataFrame, root: str, size: int = SITEMAP_SIZE) -> DataFrame:
    """Write `<host>/sitemap.xml`, which lists the host's shard files."""
    return _publish(_index_lines(entries, size), root, {"index": _document(SITEMAP_INDEX)})


def robots_policy(policies: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> str:
    """Lines of robots.txt for each (user agent, allowed paths, disallowed paths)."""
    blocks = []
    for agent, allowed, disallowed in policies:
        lines = [f"# {agent}", f"User-agent: {agent}"]
        lines += [f"Allow: {path}" for path in allowed] + [f"Disallow: {path}" for path in disallowed]
        blocks.append("\n".join(lines) + "\n\n")
    return "".join(blocks)


Policies = Sequence[tuple[str, Sequence[str], Sequence[str]]]


def _robots_lines(entries: DataFrame, policies: Policies) -> DataFrame:
    site = F.concat(F.lit("https://"), F.col("host"))
    text = F.concat(
        F.lit(robots_policy(policies)), F.lit(ROBOTS_HOST), site, F.lit(ROBOTS_SITEMAP), site, F.lit("/sitemap.xml")
    )
    return _lines(entries.select("host").distinct(), "robots", F.lit("robots.txt"), F.lit(""), text)


def publish_robots(entries: DataFrame, root: str, policies: Policies = ROBOTS_POLICIES) -> DataFrame:
    """Write `<host>/robots.txt` with the policies and the address of the index."""
    return _publish(_robots_lines(entries, policies), root, {"robots": ("", "")})


def publish_site(entries: DataFrame, root: str, size: int = SITEMAP_SIZE, policies: Policies = ROBOTS_POLICIES) -> DataFrame:
    """Write the sitemaps, index and robots.txt of every host in one pass; the entries are computed once."""
    kept = scratch_table(entries, "entries")
    lines = _sitemap_lines(with_shard(kept, size)).unionByName(_index_lines(kept, size)).unionByName(_robots_lines(kept, policies))
    return _publish(lines, root, {"sitemaps": _document(URLSET), "index": _document(SITEMAP_INDEX), "robots": ("", "")})
