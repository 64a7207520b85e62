"""Binary search inside a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits up to which the search is written out as nested conditions, which generated code runs.
WRITTEN_OUT = 64


def count_reached(limits: Sequence[Column] | Column, reached: Callable[[Column], Column]) -> Column:
    """How many of the ascending `limits` a row has reached, as int.

    `reached` says so for one limit; it is true for the first ones and false
    for the rest. A short list becomes nested conditions of logarithmic depth, an
    array column or a longer list is halved in a loop.
    """
    if isinstance(limits, Column):
        return _halving(limits, reached)
    if len(limits) > WRITTEN_OUT:
        return _halving(F.array(*limits), reached)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(reached(limits[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(limits))


def _halving(limits: Column, reached: Callable[[Column], Column]) -> Column:
    size = F.coalesce(F.size(limits), F.lit(0))
    # Each round halves the part still open; there are as many as the size has bits.
    rounds = F.sequence(F.lit(1), F.greatest(F.length(F.bin(size)), F.lit(1)))

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.call_function("div", low + high, F.lit(2)).cast("int")
        open_, up = low < high, F.coalesce(reached(F.get(limits, middle)), F.lit(False))
        return F.struct(
            F.when(open_ & up, middle + 1).otherwise(low).alias("low"),
            F.when(open_ & ~up, middle).otherwise(high).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.greatest(size, F.lit(0)).alias("high"))
    return F.aggregate(rounds, start, halve, lambda state: state["low"])
