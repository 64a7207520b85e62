"""Truth table of the pressure rule, and lookups given as tables."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from spokeworks.operators import scoring
from spokeworks.operators.joins import MAX_BROADCAST_ROWS, bounded_table

WIDTHS = ["23", "25", "28", "30", "32", "x"]
TOTALS = {179: "light", 180: "medium", 190: "medium", 200: "medium", 201: "heavy"}


def profiles(spark):
    rows = [
        (i, str(total - 20), "20", width, tubeless)
        for i, (width, total, tubeless) in enumerate(product(WIDTHS, TOTALS, ["true", "false"]))
    ]
    return rows, spark.createDataFrame(
        rows, "profile_id bigint, riderweight string, bikeweight string, tirewidth string, tubeless string"
    )


def expected_psi(row):
    _, rider, bike, width, tubeless = row
    bands = scoring.PSI_ADJUSTMENTS.get(int(width)) if width.isdigit() else None
    adjustment = bands[TOTALS[int(rider) + int(bike)]] if bands else 0
    return 100 + adjustment - (10 if tubeless == "true" else 0)


def test_truth_table(spark):
    rows, table = profiles(spark)
    psi = {r.profile_id: r.psi for r in scoring.score_profiles(table).collect()}
    assert psi == {row[0]: expected_psi(row) for row in rows}


def test_large_lookup_gives_the_same(spark):
    _, table = profiles(spark)
    lookup = spark.range(1).select(
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(w).alias("tirewidth"), F.lit(b).alias("band"), F.lit(a).alias("adjustment"))
                    for w, bands in scoring.PSI_ADJUSTMENTS.items()
                    for b, a in bands.items()
                )
            )
        ).alias("r")
    ).select("r.*")
    by_table = scoring.score_profiles(table, lookup).select("profile_id", "psi")
    by_mapping = scoring.score_profiles(table).select("profile_id", "psi")
    assert by_table.exceptAll(by_mapping).isEmpty() and by_mapping.exceptAll(by_table).isEmpty()


@pytest.mark.parametrize(
    ("rider", "bike", "width", "psi"),
    [
        ("", "", "25", 80),  # nothing entered weighs 0: light
        ("abc", "20", "25", 85),  # no number at all: medium
        ("180", "21", "", 90),  # no width entered: 25
        ("180", "21", "Choose Tire Width", 100),  # no such width: no adjustment
        ("99999999999999999999", "20", "25", 90),
    ],
)
def test_edges(spark, rider, bike, width, psi):
    table = spark.createDataFrame(
        [(rider, bike, width, "false")], "riderweight string, bikeweight string, tirewidth string, tubeless string"
    )
    assert scoring.score_profiles(table).first().psi == psi


def test_other_rule(spark):
    rows = [("90", "25", "true"), ("110", "25", "false"), ("90", "26", "false")]
    table = spark.createDataFrame(
        [(r, "0", w, t) for r, w, t in rows], "riderweight string, bikeweight string, tirewidth string, tubeless string"
    )
    rule = {25: {"light": 1, "medium": 2, "heavy": 3}}
    scored = scoring.score_profiles(
        table, rule, baseline=50, tubeless_drop=5, default=-7, light_below=100, heavy_above=105
    )
    assert sorted(r.psi for r in scored.collect()) == [43, 46, 53]


def test_message(spark):
    assert spark.range(1).select(scoring.psi_message(F.lit(85))).first()[0] == "Your recommended tire PSI is 85."


def test_large_mappings_are_tables(spark):
    """A mapping beyond the broadcast bound gives the rows that the same table gives."""
    import pyarrow as pa

    small, large = (bounded_table(spark, {"a": (pa.int64(), range(n))}) for n in (MAX_BROADCAST_ROWS, MAX_BROADCAST_ROWS + 1))
    plans = [t._jdf.queryExecution().analyzed().toString() for t in (small, large)]
    assert ["strategy=broadcast" in p for p in plans] == [True, False]
    widths = MAX_BROADCAST_ROWS // 2 + 1
    adjustments = {w: {"light": w % 7, "heavy": -w % 5} for w in range(widths)}
    banded = spark.range(0, widths + 3).selectExpr("CAST(id AS INT) AS tirewidth", "IF(id % 2 = 0, 'light', 'heavy') AS band")
    found = {r.tirewidth: r.adjustment for r in scoring.with_adjustment(banded, adjustments, default=99).collect()}
    assert found == {w: adjustments.get(w, {}).get("heavy" if w % 2 else "light", 99) for w in range(widths + 3)}
