"""Sources: tables, profile files, payload lines and sitemap XML."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.workspace import shuffle_partitions, store_uri

PROFILE_SCHEMA = "profile_id bigint, riderweight string, bikeweight string, tirewidth string, tubeless string"
# The column that holds a line that is no profile.
DAMAGED = "damaged"
ENTRY_SCHEMA = "loc string, lastmod string, changefreq string, priority double"
ENTRY_FIELDS = ("loc", "lastmod", "changefreq", "priority")
# Entries of a shard file that a task holds at once.
READ_ENTRIES = 10_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """`<folder>/<name>.parquet`, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream; its schema is taken from the files."""
    schema = read_table(spark, folder, name).schema
    # A plain path must be a folder; a pattern, here for the same name, may also be a file.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def read_profiles(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw profiles; all four fields stay text, an empty field reads as NULL or ''."""
    reader = spark.read.schema(PROFILE_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def read_checked_profiles(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Raw profiles from CSV with the whole line in `damaged` where it has too few or too many fields, or no number as id.

    An empty field of a sound line is NULL, as in `read_profiles`.
    """
    reader = spark.read.schema(f"{PROFILE_SCHEMA}, {DAMAGED} string").option("header", header)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", DAMAGED).csv(path)


def write_checked_profiles(checked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write both sides of `read_checked_profiles` in one pass, in folders; gives the sound profiles and the damaged lines.

    Sound profiles are read from `sound=true` alone, so no damaged line can be scored.
    """
    checked.withColumn("sound", F.col(DAMAGED).isNull()).write.partitionBy("sound").parquet(path)
    both = checked.sparkSession.read.schema(f"{PROFILE_SCHEMA}, {DAMAGED} string, sound boolean").parquet(path)
    return both.filter("sound").drop(DAMAGED, "sound"), both.filter("not sound").select(DAMAGED)


def read_payloads(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """JSON bodies as text, one per line or per file, so that broken ones reach the gate."""
    return spark.read.option("wholetext", whole_file).text(path).withColumnRenamed("value", "body")


def read_sitemap(spark: SparkSession, path: str, partitioned: bool = False) -> DataFrame:
    """Entries of all shard files at `path`; `partitioned` adds the folder columns host and shard."""
    schema = f"{ENTRY_SCHEMA}, host string, shard bigint" if partitioned else ENTRY_SCHEMA
    reader = spark.read.format("xml").option("rowTag", "url").schema(schema)
    return reader.load(path).withColumn("source_file", F.input_file_name())


def _shard_entries(root: str):
    """Task: the entries of each shard file that an index names, read as a stream of elements in any namespace."""

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        names = ["host", "file", *ENTRY_FIELDS]

        def table(rows: list[dict]) -> pa.RecordBatch:
            kinds = [pa.float64() if n == "priority" else pa.string() for n in names]
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for host, file in zip(*(batch.column(c).to_pylist() for c in ("host", "file")), strict=True):
                rows: list[dict] = []
                with store.open_input_stream(f"{base}/{host}/{file}") as stream:
                    top = None
                    for event, element in ElementTree.iterparse(stream, events=("start", "end")):
                        top = element if top is None else top
                        if event == "end" and local(element.tag) == "url":
                            entry = {local(field.tag): field.text for field in element if local(field.tag) in ENTRY_FIELDS}
                            entry["priority"] = float(entry["priority"]) if entry.get("priority") else None
                            rows.append({"host": host, "file": file, **entry})
                            top.clear()
                            if len(rows) == READ_ENTRIES:
                                yield table(rows)
                                rows = []
                if rows:
                    yield table(rows)

    return run


def read_published_sitemaps(spark: SparkSession, root: str, index: str = "sitemap.xml") -> DataFrame:
    """(host, file, loc, lastmod, changefreq, priority) of all entries that the sites below `root` publish.

    Follows every `<host>/sitemap.xml` to the shard files it names and reads
    those, each in one piece by one task; files that no index names are not
    read. A shard of another host, or one that is missing, fails the reading.
    """
    listed = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(f"{root.rstrip('/')}/*/{index}")
    own = F.substring_index(F.substring_index(F.input_file_name(), "/", -2), "/", 1)
    named = listed.select(F.url_decode(own).alias("host"), "loc")
    address = F.concat(F.lit("https://"), F.col("host"), F.lit("/"))
    within = F.startswith(F.col("loc"), address)
    refused = F.raise_error(F.concat(F.lit("not a file of "), F.col("host"), F.lit(": "), F.col("loc"))).cast("string")
    file = F.when(within, F.substring(F.col("loc"), F.length(address) + 1, F.length("loc"))).otherwise(refused)
    shards = named.select("host", file.alias("file")).repartition(shuffle_partitions(spark), "host", "file")
    return shards.mapInArrow(_shard_entries(store_uri(spark, root.rstrip("/"))), f"host string, file string, {ENTRY_SCHEMA}")
