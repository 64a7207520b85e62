"""Lookups in tables of breaks: every value takes the label of the last break it has reached.

Breaks given as Python values are searched inside the row, a table of any size
through an equi-join with bins of breaks; nothing is compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from spokeworks.operators.joins import MAX_BROADCAST_ROWS, bounded_table, lookup_join
from spokeworks.operators.ordinal import add_ordinal
from spokeworks.operators.search import count_reached
from spokeworks.workspace import scratch_table

# Breaks of a table that one bin holds, unless there would be more bins than may be told to all tasks.
BIN_BREAKS = 256

# Breaks of a list that are written out in the row's own expression.
SHORT_LIST = 64

_TAG = "__break"
_EDGES = "__edges"


@dataclass(frozen=True)
class Break:
    """From `limit` on values have `label`: with the limit itself, or only `after` it. Without a limit, from the start."""

    limit: float | None
    label: object
    after: bool = False


def _reached(value: Column, limit: Column, after: Column) -> Column:
    return (value > limit) | ((value == limit) & ~after)


def _known(df: DataFrame, value: str) -> Column:
    """The value, NULL for NaN."""
    column = F.col(value)
    return F.when(~F.isnan(column), column) if isinstance(df.schema[value].dataType, (DoubleType, FloatType)) else column


def band_label(value: Column, breaks: Sequence[Break], default: object = None) -> Column:
    """Label of the last break that `value` has reached, for a short list; `default` for NULL and before the first break."""
    if len(breaks) > SHORT_LIST:
        raise ValueError(f"more than {SHORT_LIST} breaks: use with_band_label")
    start = [b.label for b in breaks if b.limit is None]
    listed = sorted((b for b in breaks if b.limit is not None), key=lambda b: (b.limit, b.after))
    labels = F.array(*(F.lit(x) for x in [start[-1] if start else default, *(b.label for b in listed)]))
    limits = [F.struct(F.lit(b.limit).alias("limit"), F.lit(b.after).alias("after")) for b in listed]
    place = count_reached(limits, lambda b: _reached(value, b["limit"], b["after"]))
    return F.when(value.isNotNull(), F.get(labels, place)).otherwise(F.lit(default))


def _bins(breaks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Breaks in ascending order as one array per bin, and one row with the first break of each bin but the first."""
    once = breaks.filter("limit is not null").groupBy("limit", "after").agg(F.min("label").alias("label"))
    once = scratch_table(once, "breaks")
    size = max(BIN_BREAKS, -(-once.count() // MAX_BROADCAST_ROWS))
    placed = add_ordinal(once, ["limit", "after"], name="no").withColumn("bin", F.call_function("div", F.col("no") - 1, F.lit(size)))
    bins = placed.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("limit", "after", "label"))).alias("breaks"))
    bins = scratch_table(bins, "bins")
    # As many as may be told to all tasks at most.
    first = F.get("breaks", F.lit(0))
    edges = bins.filter("bin > 0").agg(F.sort_array(F.collect_list(F.struct(first["limit"].alias("limit"), first["after"].alias("after")))))
    return bins, scratch_table(edges.toDF("edges"), "edges")


def with_band_label(
    df: DataFrame, value: str, breaks: Sequence[Break] | DataFrame, name: str = "band", default: object = None
) -> DataFrame:
    """Add the label of the last break that column `value` has reached.

    `breaks` is a list, or a table (limit, label[, after]) of any size, `limit`
    of the value's type; of equal breaks the smallest label counts, and a NULL
    limit in a table is no break. NULL and NaN, and values before the first
    break, get `default`.
    """
    known = _known(df, value)
    if not isinstance(breaks, DataFrame):
        if len(breaks) <= SHORT_LIST:
            return df.withColumn(name, band_label(known, breaks, default))
        start = [b.label for b in breaks if b.limit is None]
        listed = [b for b in breaks if b.limit is not None]
        columns = {
            "limit": (pa.float64(), [float(b.limit) for b in listed]),
            "after": (pa.bool_(), [b.after for b in listed]),
            "label": (None, [b.label for b in listed]),
        }
        table = bounded_table(df.sparkSession, columns).withColumn("limit", F.col("limit").cast(df.schema[value].dataType))
        labelled = with_band_label(df, value, table, name)
        before = F.lit(start[-1] if start else default)
        return labelled.withColumn(name, F.when(known.isNull(), F.lit(default)).otherwise(F.coalesce(name, before)))
    kind = df.schema[value].dataType
    after = F.coalesce("after", F.lit(False)) if "after" in breaks.columns else F.lit(False)
    bins, edges = _bins(breaks.select(F.col("limit").cast(kind).alias("limit"), after.alias("after"), "label"))
    place = count_reached(F.col(_EDGES), lambda b: _reached(known, b["limit"], b["after"])).cast("bigint")
    keyed = df.withColumn(_EDGES, edges.scalar()).withColumn(_TAG, F.when(known.isNotNull(), place)).drop(_EDGES)
    found = lookup_join(keyed, bins.select(F.col("bin").alias(_TAG), F.col("breaks").alias("__breaks")), [_TAG], "left")
    # A bin's breaks are sorted: the last one reached.
    held = F.col("__breaks")
    own = F.get(held, count_reached(held, lambda b: _reached(known, b["limit"], b["after"])) - 1)
    return found.withColumn(name, F.coalesce(own["label"], F.lit(default))).drop(_TAG, "__breaks")
