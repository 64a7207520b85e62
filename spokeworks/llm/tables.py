"""Reading the given tables and cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.workspace import scratch_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back."""
    return scratch_table(df, label)


def held_out(doc_id: Column | str) -> Column:
    """True for documents that no model may learn from: crc32 of the id's text, mod 5, is 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 5 == 0, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as keep it apart from all columns."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
