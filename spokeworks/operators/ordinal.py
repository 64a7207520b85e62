"""Exact row numbers without sending all rows, or all rows of a key, to one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.operators.search import count_reached
from spokeworks.workspace import scratch_table, shuffle_partitions

_BUCKET = "__bucket"
_LIMITS = "__limits"
_OWN = "__own"
_SHIFT = "__shift"
_WEIGHT = "__weight"
_EARLIER = "__earlier"

# Keys of up to this many rows are left to one task.
HOT_KEY_ROWS = 1_000_000
# Buckets for each shuffle partition, so that their hashes fill the partitions evenly, and at most.
BUCKETS_EACH = 4
MAX_BUCKETS = 4_096
# Sampled rows for each bucket; a bucket's size then varies by about a quarter.
SAMPLED_EACH = 16


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [left[key].eqNullSafe(right[key]) for key in keys]


@dataclass(frozen=True)
class Splitters:
    """Ascending values of the sort columns that cut their order into buckets: a table of one row with all of them."""

    order: tuple[str, ...]
    limits: DataFrame

    def with_bucket(self, df: DataFrame) -> DataFrame:
        """Add the bucket of every row, ascending with the sort columns; NULLs come first, as in a sort."""
        told = df.withColumns({_LIMITS: self.limits.scalar(), _OWN: F.struct(*self.order)})
        reached = count_reached(F.col(_LIMITS), lambda limit: F.col(_OWN) >= limit)
        return told.withColumn(_BUCKET, reached).drop(_LIMITS, _OWN)


def fit_splitters(df: DataFrame, order: Sequence[str], buckets: int | None = None, folder: str | None = None) -> Splitters:
    """Splitters for about equally many rows in each bucket.

    They are quantiles of a sample: the rows with the smallest hashes, which
    every task selects from its own rows and any two selections merge. It is the
    same for the same rows, however they are split, and of bounded size.
    """
    buckets = buckets or min(BUCKETS_EACH * shuffle_partitions(df.sparkSession), MAX_BUCKETS)
    sample = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(SAMPLED_EACH * buckets)
    rows = sample.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("rows"))
    place = lambda n: F.get("rows", F.call_function("div", F.size("rows") * n, F.lit(buckets)).cast("int"))
    chosen = F.when(F.size("rows") > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), place)))
    limits = rows.select(F.coalesce(chosen if buckets > 1 else F.lit(None), F.slice("rows", 1, 0)).alias("limits"))
    return Splitters(tuple(order), scratch_table(limits, "splitters", folder))


def bucket_runs(df: DataFrame, splitters: Splitters, within: Sequence[str] = ()) -> DataFrame:
    """Rows per bucket and key, as column `n`."""
    return splitters.with_bucket(df).groupBy(_BUCKET, *within).agg(F.count("*").alias("n"))


def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    within: Sequence[str] = (),
    name: str = "ordinal",
    start: DataFrame | None = None,
    folder: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """1-based ordinals per key, whatever the keys' sizes.

    Rows are dealt into buckets of the order by key and `order_by`, numbered
    inside each bucket and shifted by the rows of the key in the buckets before.
    A hot key fills as many buckets as it needs, and the rows themselves are
    shuffled once and written nowhere. `df` is read three times: for the
    splitters and the counts, of the sort columns alone, and for the numbers.
    `start` (key columns, `start` bigint) continues an earlier count.
    """
    keys = list(within)
    if start is not None and not keys:
        raise ValueError("a start needs key columns")
    splitters = fit_splitters(df, [*keys, *order_by], buckets, folder)
    runs = bucket_runs(df.select(*dict.fromkeys([*keys, *order_by])), splitters, keys)
    inside = Window.partitionBy(_BUCKET, *keys).orderBy(*order_by)
    numbered = splitters.with_bucket(df).withColumn(name, F.row_number().over(inside).cast("bigint"))
    if not keys:
        # One number for each bucket.
        sizes = {row[_BUCKET]: row.n for row in runs.collect()}
        shifts = list(accumulate((sizes.get(b, 0) for b in range(max(sizes, default=0))), initial=0))
        told = df.sparkSession.createDataFrame([(shifts,)], "shifts array<bigint>")
        return numbered.withColumn(name, F.col(name) + F.get(told.scalar(), F.col(_BUCKET))).drop(_BUCKET)
    base = F.lit(0)
    if start is not None:
        begun = runs.join(start, _same_key(runs, start, keys), "left")
        runs = begun.select(*(runs[c] for c in runs.columns), start["start"])
        base = F.coalesce("start", F.lit(0))
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("n").over(before), F.lit(0))
    shifts = scratch_table(runs.select(_BUCKET, *keys, (earlier + base).alias(_SHIFT)), "shifts", folder)
    match = [numbered[_BUCKET] == shifts[_BUCKET], *_same_key(numbered, shifts, keys)]
    # A (bucket, key) pair holds at most one bucket, so the join has no hot key; the
    # written table's size decides whether Spark broadcasts it.
    return numbered.join(shifts, match).select(
        *(numbered[c] for c in df.columns),
        (numbered[name] + shifts[_SHIFT]).alias(name),
    )


def key_counts(df: DataFrame, within: Sequence[str]) -> DataFrame:
    """Rows per key, as column `n`."""
    return df.groupBy(*within).agg(F.count("*").alias("n"))


def hot_keys(counts: DataFrame, within: Sequence[str], least_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Keys with more than `least_rows` rows, the number one task is left to sort."""
    return counts.filter(F.col("n") > least_rows).select(*within)


def _window_ordinal(
    df: DataFrame, order_by: Sequence[str], within: Sequence[str], name: str, start: DataFrame | None
) -> DataFrame:
    window = Window.partitionBy(*within)
    if start is None:
        return df.withColumn(name, F.row_number().over(window.orderBy(*order_by)).cast("bigint"))
    # An earlier count comes first in its key's window, as one row that weighs that much.
    counted = df.withColumns({_WEIGHT: F.lit(1).cast("bigint"), _EARLIER: F.lit(False)})
    earlier = start.select(*within, F.col("start").alias(_WEIGHT), F.lit(True).alias(_EARLIER))
    running = window.orderBy(F.desc(_EARLIER), *order_by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counted.unionByName(earlier, allowMissingColumns=True)
        .withColumn(name, F.sum(_WEIGHT).over(running))
        .filter(~F.col(_EARLIER))
        .drop(_WEIGHT, _EARLIER)
    )


def add_ordinal(
    df: DataFrame,
    order_by: Sequence[str],
    within: Sequence[str] = (),
    name: str = "ordinal",
    hot_key_rows: int = HOT_KEY_ROWS,
    counts: DataFrame | None = None,
    start: DataFrame | None = None,
    folder: str | None = None,
) -> DataFrame:
    """`row_number` over `order_by`, per `within` or over the whole table.

    Keys of more than `hot_key_rows` go through `number_rows`, which may use many
    tasks for one key; the bound is what a task can sort and depends on no
    setting. For all others a window does the same with a single shuffle. The
    order has to be unique within a key: then both give the same numbers, while
    rows that tie may get theirs in any order. `df` is read several times, so
    pass a table or a cheap plan that gives the same rows each time. `counts` per
    key are taken instead of counting; `start` and `folder`, for the small tables
    written on the way, are those of `number_rows`.
    """
    if not within:
        return number_rows(df, order_by, (), name, start, folder)
    counts = key_counts(df, within) if counts is None else counts
    hot = scratch_table(hot_keys(counts, within, hot_key_rows), "hot", folder)
    if hot.isEmpty():
        return _window_ordinal(df, order_by, within, name, start)
    # The written list's size decides whether Spark broadcasts it; a hot key's rows split otherwise.
    same = _same_key(df, hot, within)
    heavy = df.join(hot, same, "left_semi")
    light = df.join(hot, same, "left_anti")
    numbered = number_rows(heavy, order_by, within, name, start, folder)
    return numbered.unionByName(_window_ordinal(light, order_by, within, name, start))
