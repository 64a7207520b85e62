"""Profile scoring with a banded lookup table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.functions import parse_flag, parse_int
from spokeworks.operators.joins import MAX_BROADCAST_ROWS, bounded_table, lookup_join
from spokeworks.operators.ranges import Break, band_label, with_band_label

# Fixed values of the tyre-pressure rule, in pounds and psi.
LIGHT_BELOW = 180
HEAVY_ABOVE = 200
BASELINE_PSI = 100
TUBELESS_DROP = 10
DEFAULT_WIDTH = "25"
PSI_ADJUSTMENTS = {
    23: {"light": -5, "medium": 0, "heavy": 5},
    25: {"light": -20, "medium": -15, "heavy": -10},
    28: {"light": -35, "medium": -30, "heavy": -25},
    30: {"light": -40, "medium": -35, "heavy": -30},
    32: {"light": -43, "medium": -38, "heavy": -33},
}

# The band of a weight that is no number.
UNKNOWN_BAND = "medium"

Adjustments = Mapping[int, Mapping[str, int]]

_WEIGHT = "__total_weight"


def coerce_profile(profiles: DataFrame) -> DataFrame:
    """Numbers and flag from the raw text fields; unusable numbers become NULL."""
    return profiles.withColumns(
        {
            "riderweight": parse_int(F.col("riderweight")),
            "bikeweight": parse_int(F.col("bikeweight")),
            "tirewidth": parse_int(F.col("tirewidth"), DEFAULT_WIDTH).try_cast("int"),
            "tubeless": parse_flag(F.col("tubeless")),
        }
    )


def weight_breaks(light_below: float = LIGHT_BELOW, heavy_above: float = HEAVY_ABOVE) -> list[Break]:
    """light, then medium from one limit on, then heavy beyond the other."""
    return [Break(None, "light"), Break(light_below, UNKNOWN_BAND), Break(heavy_above, "heavy", after=True)]


def weight_band(total: Column, light_below: float = LIGHT_BELOW, heavy_above: float = HEAVY_ABOVE) -> Column:
    """light, medium or heavy; both limits and NULL are medium."""
    return band_label(total, weight_breaks(light_below, heavy_above), UNKNOWN_BAND)


def with_band(
    profiles: DataFrame,
    light_below: float = LIGHT_BELOW,
    heavy_above: float = HEAVY_ABOVE,
    breaks: Sequence[Break] | DataFrame | None = None,
    unknown: str = UNKNOWN_BAND,
) -> DataFrame:
    """Add the total weight's band to coerced profiles.

    `breaks` replaces the three bands: a list, or a table (limit, label[, after])
    of any size. Profiles without a total, or before the first break, get `unknown`.
    """
    weighed = profiles.withColumn(_WEIGHT, F.col("riderweight") + F.col("bikeweight"))
    breaks = weight_breaks(light_below, heavy_above) if breaks is None else breaks
    return with_band_label(weighed, _WEIGHT, breaks, "band", unknown).drop(_WEIGHT)


def adjustment_table(spark: SparkSession, adjustments: Adjustments = PSI_ADJUSTMENTS) -> DataFrame:
    """The nested mapping as rows of (tirewidth, band, adjustment)."""
    rows = [(width, band, value) for width, bands in adjustments.items() for band, value in bands.items()]
    widths, bands, values = zip(*rows, strict=True)
    return bounded_table(
        spark,
        {
            "tirewidth": (pa.int32(), widths),
            "band": (pa.string(), bands),
            "adjustment": (pa.int64(), values),
        },
    )


def with_adjustment(
    banded: DataFrame, adjustments: Adjustments | DataFrame = PSI_ADJUSTMENTS, default: int = 0
) -> DataFrame:
    """Look up (tirewidth, band); pairs the table lacks get `default`.

    A mapping is broadcast if it is small. A DataFrame, with at most one row
    per pair, may be of any size.
    """
    keys = ["tirewidth", "band"]
    if isinstance(adjustments, DataFrame):
        joined = lookup_join(banded, adjustments, keys, "left")
    elif sum(map(len, adjustments.values())) <= MAX_BROADCAST_ROWS:
        joined = banded.join(adjustment_table(banded.sparkSession, adjustments), keys, "left")
    else:
        joined = lookup_join(banded, adjustment_table(banded.sparkSession, adjustments), keys, "left")
    return joined.withColumn("adjustment", F.coalesce("adjustment", F.lit(default).cast("bigint")))


def score_profiles(
    profiles: DataFrame,
    adjustments: Adjustments | DataFrame = PSI_ADJUSTMENTS,
    baseline: int = BASELINE_PSI,
    tubeless_drop: int = TUBELESS_DROP,
    default: int = 0,
    light_below: float = LIGHT_BELOW,
    heavy_above: float = HEAVY_ABOVE,
    breaks: Sequence[Break] | DataFrame | None = None,
    unknown_band: str = UNKNOWN_BAND,
) -> DataFrame:
    """Recommended pressure per raw profile, as bigint column `psi`; `breaks` and `unknown_band` as in `with_band`."""
    banded = with_band(coerce_profile(profiles), light_below, heavy_above, breaks, unknown_band)
    scored = with_adjustment(banded, adjustments, default)
    drop = F.when(F.col("tubeless"), F.lit(tubeless_drop)).otherwise(F.lit(0))
    return scored.withColumn("psi", (F.lit(baseline) + F.col("adjustment") - drop).cast("bigint"))


def psi_message(psi: Column) -> Column:
    """The sentence shown to the rider."""
    return F.concat(F.lit("Your recommended tire PSI is "), psi.cast("string"), F.lit("."))
