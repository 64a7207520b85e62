"""Joins against lookup tables, small and large."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which a table given as Python values is marked for broadcast.
MAX_BROADCAST_ROWS = 10_000


def bounded_table(spark: SparkSession, columns: Mapping[str, tuple[pa.DataType, Sequence]]) -> DataFrame:
    """A lookup given as Python values; marked for broadcast if it is small, else a table like any other."""
    table = pa.table({name: pa.array(values, dtype) for name, (dtype, values) in columns.items()})
    frame = spark.createDataFrame(table)
    return F.broadcast(frame) if table.num_rows <= MAX_BROADCAST_ROWS else frame


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join whose hot left keys AQE can split, for `right` of any size.

    AQE splits a skewed partition only when both join inputs are plain
    shuffles. A `right` just deduplicated by the same key would be joined in
    place, without one. The second, dependent key makes Spark shuffle it again,
    which is cheap next to the left side. Spark still broadcasts `right` when
    its statistics show that it is small.
    """
    for name in on:
        ours, theirs = left.schema[name].dataType, right.schema[name].dataType
        if ours != theirs:
            raise ValueError(f"join column {name}: {ours.simpleString()} and {theirs.simpleString()}")
    tag = "__key_hash"
    while tag in left.columns or tag in right.columns:
        tag = f"_{tag}"
    return (
        left.withColumn(tag, F.xxhash64(*on))
        .join(right.withColumn(tag, F.xxhash64(*on)), [*on, tag], how)
        .drop(tag)
    )
