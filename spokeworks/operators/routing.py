"""Content types and route resolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.functions import file_extension
from spokeworks.operators.joins import MAX_BROADCAST_ROWS, bounded_table, lookup_join

# Fixed values of the extension table.
CONTENT_TYPES = {
    ".html": "text/html",
    ".css": "text/css",
    ".js": "text/javascript",
}


def with_content_type(
    objects: DataFrame, key: str = "object_key", types: Mapping[str, str] | DataFrame = CONTENT_TYPES
) -> DataFrame:
    """Add `content_type` by extension, NULL for extensions not listed.

    `types` is a mapping or a table (ext, content_type) with one row per
    extension, of any size.
    """
    if isinstance(types, DataFrame):
        table = types.select(F.col("ext").alias("_ext"), "content_type")
    else:
        columns = {"_ext": (pa.string(), list(types)), "content_type": (pa.string(), list(types.values()))}
        table = bounded_table(objects.sparkSession, columns)
    keyed = objects.withColumn("_ext", file_extension(F.col(key)))
    if not isinstance(types, DataFrame) and len(types) <= MAX_BROADCAST_ROWS:
        return keyed.join(table, "_ext", "left").drop("_ext")
    return lookup_join(keyed, table, ["_ext"], "left").drop("_ext")


def resolve_routes(
    requests: DataFrame,
    objects: DataFrame,
    key: str = "object_key",
    scope: Sequence[str] = (),
    error_key: str = "error.html",
) -> DataFrame:
    """Add `served_key`: the requested object if it exists, else the error document.

    `scope` names columns such as the host that are part of the key. Both tables
    may be large; a request that makes up much of the table is split at run time.
    """
    on = [*scope, key]
    known = objects.select(*on).distinct().withColumn("found", F.lit(True))
    found = F.coalesce("found", F.lit(False))
    return (
        lookup_join(requests, known, on, "left")
        .withColumn("found", found)
        .withColumn("served_key", F.when(F.col("found"), F.col(key)).otherwise(F.lit(error_key)))
    )


def store_objects(
    objects: DataFrame, name: str, buckets: int, key: str = "object_key", scope: Sequence[str] = (), path: str | None = None
) -> None:
    """Keep the distinct objects as table `name`, in `buckets` sorted by key, for `resolve_stored_routes`.

    Take as many buckets as requests have shuffle partitions, or more: then
    requests move to the objects, and the objects stay where they are.
    """
    on = [*scope, key]
    writer = objects.select(*on).distinct().repartition(buckets, *on).write.mode("overwrite")
    (writer.option("path", path) if path else writer).bucketBy(buckets, *on).sortBy(*on).saveAsTable(name)


def resolve_stored_routes(
    requests: DataFrame, name: str, key: str = "object_key", scope: Sequence[str] = (), error_key: str = "error.html"
) -> DataFrame:
    """`resolve_routes` against the objects that `store_objects` has kept, as often as there are requests.

    Every key that is asked for is looked up once, however many requests ask
    for it; only those keys are shuffled to the objects' buckets. `requests` is
    read twice, so pass a table or a cheap plan.
    """
    on = [*scope, key]
    known = requests.sparkSession.table(name).select(*on, F.lit(True).alias("found"))
    asked = requests.select(*on).distinct().join(known, on, "inner")
    return (
        lookup_join(requests, asked, on, "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
        .withColumn("served_key", F.when(F.col("found"), F.col(key)).otherwise(F.lit(error_key)))
    )
