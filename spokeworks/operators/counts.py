"""Visit totals and ordinals over a hit table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.operators.ordinal import add_ordinal


def visit_totals(visits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hits per key, or over the whole table; partial counts combine before the shuffle."""
    return visits.groupBy(*keys).agg(F.count("*").alias("visits"))


def visit_ordinals(visits: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Number every hit with the count it raised its key to."""
    return add_ordinal(visits, order_by, keys, "visit_no")
