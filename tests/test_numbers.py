"""Parsing and exact rounding."""

import decimal
from decimal import Decimal

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spokeworks.functions import fixed1_tenths, fixed1_text, fixed1_value, parse_flag, parse_float, parse_int
from spokeworks.operators import nutrition

decimal.getcontext().prec = 400

# text, as_int, as_float
CASES = [
    ("150", 150.0, 150.0),
    ("150.9", 150.0, 150.9),
    ("12abc", 12.0, 12.0),
    (" 42", 42.0, 42.0),
    (" ﻿7", 7.0, 7.0),
    ("", 0.0, 0.0),
    (None, 0.0, 0.0),
    ("abc", None, None),
    ("-", None, None),
    (".", None, None),
    ("-5", -5.0, -5.0),
    ("+5", 5.0, 5.0),
    ("1e2", 1.0, 100.0),
    ("1e", 1.0, 1.0),
    (".5", None, 0.5),
    ("5.", 5.0, 5.0),
    ("1.2.3", 1.0, 1.2),
    ("7f", 7.0, 7.0),
    ("99999999999999999999", 1e20, 1e20),
    ("Infinity", None, float("inf")),
]


def test_coercion(spark):
    table = spark.createDataFrame([(c[0],) for c in CASES], "v string")
    rows = table.select("v", parse_int(F.col("v")), parse_float(F.col("v"))).collect()
    assert {tuple(r) for r in rows} == set(CASES)


def test_default_applies_to_missing_text_only(spark):
    table = spark.createDataFrame([("",), (None,), ("x",)], "v string")
    assert [r[0] for r in table.select(parse_int(F.col("v"), "25")).collect()] == [25.0, 25.0, None]


def test_flag(spark):
    table = spark.createDataFrame([("true",), ("True",), ("",), (None,)], "v string")
    assert [r[0] for r in table.select(parse_flag(F.col("v"))).collect()] == [True, False, False, False]


def exact(x):
    """JavaScript's rule in exact decimals: ties away from zero, sign kept."""
    size = str(Decimal(abs(x)).quantize(Decimal("0.1"), rounding=decimal.ROUND_HALF_UP))
    return ("-" if x < 0 else "") + size


def check_rounding(spark, values):
    table = spark.createDataFrame(pa.table({"x": pa.array(values, pa.float64())}))
    x = F.col("x")
    for row in table.select(x, fixed1_text(x).alias("text"), fixed1_tenths(x).alias("tenths")).collect():
        assert row.text == exact(row.x)
        assert row.tenths == int(Decimal(exact(row.x)) * 10)


def test_rounding_of_weights_and_foods(spark):
    weights = [i / 10 for i in range(3001)] + list(range(80, 301))
    carbs = [w / 3 for w in weights]
    foods = [float(exact(c)) / each for c in carbs for each in nutrition.FOOD_CARBS.values()]
    ties = [i / 4 for i in range(400)]
    check_rounding(spark, carbs + foods + ties + [-v for v in ties])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-8e17, 8e17, allow_nan=False), min_size=1, max_size=200))
def test_rounding_of_any_double(spark, values):
    check_rounding(spark, values)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(9e17, 9.99e20), min_size=1, max_size=100))
def test_text_of_large_doubles(spark, values):
    table = spark.createDataFrame(pa.table({"x": pa.array([*values, *(-v for v in values)], pa.float64())}))
    for row in table.select("x", fixed1_text(F.col("x")).alias("t"), fixed1_value(F.col("x")).alias("v")).collect():
        assert row.t == f"{int(row.x)}.0" and row.v == row.x


def test_text_beyond_plain_digits(spark):
    cases = {1e21: "1e+21", 1.5e300: "1.5e+300", float("inf"): "Infinity", float("-inf"): "-Infinity", -2e22: "-2e+22"}
    rows = spark.createDataFrame([(x,) for x in cases], "x double").select("x", fixed1_text(F.col("x")).alias("t"), fixed1_value(F.col("x")).alias("v")).collect()
    assert {r.x: r.t for r in rows} == cases and all(r.v == r.x for r in rows)
    none = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(fixed1_text(F.col("x")), fixed1_value(F.col("x")), fixed1_tenths(F.col("x")))
    assert {tuple(r) for r in none.collect()} == {(None, None, None)}
    # Tenths themselves end where a bigint does.
    big = spark.createDataFrame([(1e18,), (float("inf"),)], "x double")
    assert {r[0] for r in big.select(fixed1_tenths(F.col("x"))).collect()} == {None}


def test_value_of_rounded_text(spark):
    values = [i / 7 for i in range(2000)] + [2.0**k / 3 for k in range(40, 62)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(fixed1_text(F.col("x")), fixed1_value(F.col("x"))).collect()
    assert all(float(text) == value for text, value in rows)


@pytest.mark.parametrize(
    ("weight", "text"),
    [
        # 150 / 3 = 50.0; 50 / 27 = 1.85, 50 / 23 = 2.17, 50 / 14 = 3.57
        (150.0, "50.0. You could get this amount of nutrition from 1.9 bananas, 2.2 Gu gel packets, or 3.6 tacos"),
        (-0.1, "-0.0. You could get this amount of nutrition from 0.0 bananas, 0.0 Gu gel packets, or 0.0 tacos"),
        (-0.3, "-0.1. You could get this amount of nutrition from -0.0 bananas, -0.0 Gu gel packets, or -0.0 tacos"),
        (0.0, "0.0. You could get this amount of nutrition from 0.0 bananas, 0.0 Gu gel packets, or 0.0 tacos"),
        (float("inf"), "Infinity. You could get this amount of nutrition from Infinity bananas, Infinity Gu gel packets, or Infinity tacos"),
        (3e18, f"{10**18}.0. You could get this amount of nutrition from {int(1e18 / 27)}.0 bananas, {int(1e18 / 23)}.0 Gu gel packets, or {int(1e18 / 14)}.0 tacos"),
        (6e30, f"{6e30 / 3!r}. You could get this amount of nutrition from {6e30 / 3 / 27!r} bananas, {6e30 / 3 / 23!r} Gu gel packets, or {6e30 / 3 / 14!r} tacos"),
        (None, "NaN. You could get this amount of nutrition from NaN bananas, NaN Gu gel packets, or NaN tacos"),
    ],
)
def test_carb_message(spark, weight, text):
    riders = nutrition.with_carbs(spark.createDataFrame([(weight,)], "weight double"))
    message = nutrition.with_carb_message(riders).first().message
    assert message.startswith(f"Your recommended number of carbs per hour is {text} per hour. (Don't forget")
    assert message.endswith("sports drink or other supplements.)")
