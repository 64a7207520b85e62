"""Keyed record assembly with duplicate-key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeworks.operators.ordinal import add_ordinal
from spokeworks.workspace import scratch_table


def keyed_records(df: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """Rows as (key, record), the record's fields renamed by `fields` (new name -> column)."""
    record = F.struct(*(F.col(column).alias(name) for name, column in fields.items()))
    return df.select(F.col(key).alias("key"), record.alias("record"))


def outside_apex(host: Column, apex: Column) -> Column:
    """True for hosts that are neither the apex nor its www twin."""
    return (host != apex) & (host != F.concat(F.lit("www."), apex))


def _refused(key: Column) -> Column:
    """A condition that fails the job; as a filter no reader of other columns can prune it."""
    return F.raise_error(F.concat(F.lit("duplicate key: "), key.cast("string"))).cast("boolean")


def require_unique(df: DataFrame, group: Sequence[str], key: str, value: str) -> DataFrame:
    """Rows unchanged; the job fails if a (group, key) occurs twice, whatever columns are read.

    Duplicates combine before the shuffle, so a much repeated key stays cheap.
    """
    counted = df.groupBy(*group, key).agg(F.count("*").alias("_n"), F.first(value).alias(value))
    return counted.filter(F.when(F.col("_n") > 1, _refused(F.col(key))).otherwise(F.lit(True))).select(*group, key, value)


def unique_key_maps(
    df: DataFrame, group: Sequence[str], key: str, value: str, max_entries: int | None = None
) -> DataFrame:
    """Rows as one map per group, keys in order; a key that a group repeats fails the job.

    One shuffle. A map is one value, so its group has to fit a row; for groups
    that do not, `max_entries` asks for parts of at most that many keys: every
    `max_entries` of a group's keys make one row (`part` 0, 1, ...).
    """
    entries = F.sort_array(F.collect_list(F.struct(key, value))).alias("_e")
    if max_entries is None:
        grouped = df.groupBy(*group).agg(entries)
        repeated = F.filter(
            F.transform("_e", lambda e, i: F.when((i > 0) & (e[key] == F.get(F.col("_e"), i - 1)[key]), e[key])),
            lambda k: k.isNotNull(),
        )
        fits = F.when(F.size(repeated) > 0, _refused(F.get(repeated, 0))).otherwise(F.lit(True))
        return grouped.filter(fits).select(*group, F.map_from_entries("_e").alias("entries"))
    checked = scratch_table(require_unique(df, group, key, value), "unique")
    numbered = add_ordinal(checked, [key], group, "_no")
    part = F.call_function("div", F.col("_no") - 1, F.lit(max_entries)).alias("part")
    return numbered.groupBy(*group, part).agg(entries).select(*group, "part", F.map_from_entries("_e").alias("entries"))
