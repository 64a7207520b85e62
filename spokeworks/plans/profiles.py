"""Tyre pressure and nutrition plans (rider profiles derived from orders and customers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.functions import fixed1_text, parse_float, parse_int
from spokeworks.operators import nutrition, scoring
from spokeworks.operators.ranges import with_band_label
from spokeworks.sources import read_checked_profiles, read_profiles, read_table, write_checked_profiles
from spokeworks.workspace import scratch_path

_WIDTHS = ["23", "25", "28", "30", "32", "27", "x"]


def rider_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One raw profile per order; some weights are empty or unusable."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    weight = F.when(order % 97 == 0, "").when(order % 101 == 0, "abc").otherwise((order % 221 + 80).cast("string"))
    width = F.element_at(F.array(*(F.lit(w) for w in _WIDTHS)), (order % len(_WIDTHS) + 1).cast("int"))
    return read_table(spark, folder, "orders").select(
        order.alias("profile_id"),
        weight.alias("riderweight"),
        (customer % 21 + 10).cast("string").alias("bikeweight"),
        width.alias("tirewidth"),
        F.when(customer % 2 == 0, "true").otherwise("false").alias("tubeless"),
    )


def rider_weights(spark: SparkSession, folder: str) -> DataFrame:
    """One weight per customer, in steps of a tenth of a pound, as the text a form holds."""
    key = F.col("c_custkey")
    text = F.concat((key % 221 + 80).cast("string"), F.lit("."), (key % 10).cast("string"), F.lit(" lbs"))
    return read_table(spark, folder, "customer").select(
        "c_custkey", F.when(key % 53 == 0, "heavy").otherwise(text).alias("weight_text")
    )


def coerce_numeric(spark: SparkSession, folder: str) -> DataFrame:
    table = rider_weights(spark, folder)
    text = F.col("weight_text")
    return table.select(
        "c_custkey", parse_int(text).try_cast("bigint").alias("as_int"), parse_float(text).alias("as_float")
    )


def weight_band(spark: SparkSession, folder: str) -> DataFrame:
    banded = scoring.with_band(scoring.coerce_profile(rider_profiles(spark, folder)))
    return banded.select("profile_id", "band")


def psi_adjustment_lookup(spark: SparkSession, folder: str) -> DataFrame:
    banded = scoring.with_band(scoring.coerce_profile(rider_profiles(spark, folder)))
    return scoring.with_adjustment(banded).select("profile_id", "adjustment")


def psi_score(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_profiles(rider_profiles(spark, folder)).select("profile_id", "psi")


def psi_score_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles written as CSV and read back as raw text before scoring."""
    path = scratch_path(spark, "profiles-csv")
    rider_profiles(spark, folder).write.option("header", True).csv(path)
    return scoring.score_profiles(read_profiles(spark, path)).select("profile_id", "psi")


def psi_message(spark: SparkSession, folder: str) -> DataFrame:
    return psi_score(spark, folder).select("profile_id", scoring.psi_message(F.col("psi")).alias("message"))


def price_band(spark: SparkSession, folder: str) -> DataFrame:
    """The dearest part whose price each line item's price reaches: as many breaks as there are prices."""
    part = read_table(spark, folder, "part")
    breaks = part.select(F.col("p_retailprice").alias("limit"), F.col("p_partkey").alias("label"))
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return with_band_label(lines, "l_extendedprice", breaks, "reached").select("l_orderkey", "l_linenumber", "l_extendedprice", "reached")


def psi_score_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Pressures by a rule that lies in tables: a weight band for each nation, and their adjustments by width."""
    nation = read_table(spark, folder, "nation")
    key = F.col("n_nationkey")
    breaks = nation.select((key * 9 + 95).alias("limit"), F.col("n_name").alias("label"), (key % 2 == 1).alias("after"))
    widths = F.explode(F.array(*(F.lit(int(w)) for w in _WIDTHS[:5]))).alias("tirewidth")
    rule = nation.select(widths, F.col("n_name").alias("band"), key)
    rule = rule.select("tirewidth", "band", (key * 2 - F.col("tirewidth")).cast("bigint").alias("adjustment"))
    scored = scoring.score_profiles(rider_profiles(spark, folder), rule, breaks=breaks, unknown_band="none", default=-1)
    return scored.select("profile_id", "band", "psi")


def _damaged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles as lines of text; some end early, some run on, some have no number where the id is."""
    key = F.col("profile_id")
    fields = ["riderweight", "bikeweight", "tirewidth", "tubeless"]
    whole = F.concat_ws(",", key.cast("string"), *fields)
    line = (
        F.when(key % 19 == 3, F.concat_ws(",", key.cast("string"), *fields[:2]))
        .when(key % 23 == 5, F.concat(whole, F.lit(",true")))
        .when(key % 29 == 7, F.concat(F.lit("no"), whole))
        .otherwise(whole)
    )
    return rider_profiles(spark, folder).select(line.alias("value"))


def psi_score_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Pressure of every sound line of a damaged file, and the damaged lines as they stood."""
    text, checked = scratch_path(spark, "profile-lines"), scratch_path(spark, "profiles-checked")
    _damaged_lines(spark, folder).write.text(text)
    sound, damaged = write_checked_profiles(read_checked_profiles(spark, text, header=False), checked)
    scored = scoring.score_profiles(sound).select("profile_id", "psi", F.lit(None).cast("string").alias("damaged"))
    none = F.lit(None).cast("bigint")
    return scored.unionByName(damaged.select(none.alias("profile_id"), none.alias("psi"), "damaged"))


def to_fixed_1(spark: SparkSession, folder: str) -> DataFrame:
    """Thirds of prices; every 89th order's are scaled beyond a bigint, every 97th's beyond plain digits."""
    order = F.col("l_orderkey")
    scale = F.when(order % 89 == 0, 2.0**50).when(order % 97 == 0, 2.0**80).otherwise(1.0)
    third = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 3 * scale).alias("third")
    )
    return third.select("l_orderkey", "l_linenumber", fixed1_text(F.col("third")).alias("rounded"))


def _planned(spark: SparkSession, folder: str) -> DataFrame:
    weighed = rider_weights(spark, folder).withColumn("weight", parse_float(F.col("weight_text")))
    return nutrition.with_carbs(weighed)


def carb_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _planned(spark, folder).select("c_custkey", "carbs_tenths", "carbs")


def carb_food_equivalents(spark: SparkSession, folder: str) -> DataFrame:
    return nutrition.food_equivalents(_planned(spark, folder)).select("c_custkey", "food", "pieces_tenths")


def carb_message(spark: SparkSession, folder: str) -> DataFrame:
    return nutrition.with_carb_message(_planned(spark, folder)).select("c_custkey", "message")


QUERIES = {
    "coerce_numeric": coerce_numeric,
    "weight_band": weight_band,
    "psi_adjustment_lookup": psi_adjustment_lookup,
    "psi_score": psi_score,
    "psi_score_csv": psi_score_csv,
    "psi_message": psi_message,
    "price_band": price_band,
    "psi_score_bands": psi_score_bands,
    "psi_score_rejects": psi_score_rejects,
    "to_fixed_1": to_fixed_1,
    "carb_plan": carb_plan,
    "carb_food_equivalents": carb_food_equivalents,
    "carb_message": carb_message,
}

_PROFILE_SQL = """
WITH raw AS (
  SELECT o_orderkey AS profile_id,
    CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 101 = 0 THEN 'abc'
         ELSE CAST(80 + o_orderkey % 221 AS VARCHAR) END AS riderweight,
    CAST(10 + o_custkey % 21 AS VARCHAR) AS bikeweight,
    ['23','25','28','30','32','27','x'][CAST(o_orderkey % 7 + 1 AS INTEGER)] AS tirewidth,
    CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS tubeless
  FROM orders),
num AS (
  SELECT profile_id,
    TRY_CAST(NULLIF(regexp_extract(COALESCE(NULLIF(riderweight, ''), '0'), '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT)
    + TRY_CAST(NULLIF(regexp_extract(COALESCE(NULLIF(bikeweight, ''), '0'), '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT)
      AS total,
    TRY_CAST(NULLIF(regexp_extract(COALESCE(NULLIF(tirewidth, ''), '25'), '^\\s*([+-]?[0-9]+)', 1), '') AS INTEGER)
      AS width,
    COALESCE(tubeless = 'true', FALSE) AS tubeless
  FROM raw),
band AS (
  SELECT *, CASE WHEN total < 180 THEN 'light' WHEN total > 200 THEN 'heavy' ELSE 'medium' END AS band
  FROM num),
-- fixed values of the pressure adjustment table
adj(w, b, a) AS (VALUES
  (23, 'light', -5), (23, 'medium', 0), (23, 'heavy', 5),
  (25, 'light', -20), (25, 'medium', -15), (25, 'heavy', -10),
  (28, 'light', -35), (28, 'medium', -30), (28, 'heavy', -25),
  (30, 'light', -40), (30, 'medium', -35), (30, 'heavy', -30),
  (32, 'light', -43), (32, 'medium', -38), (32, 'heavy', -33)),
scored AS (
  SELECT profile_id, band, CAST(COALESCE(a, 0) AS BIGINT) AS adjustment,
    CAST(100 + COALESCE(a, 0) - CASE WHEN tubeless THEN 10 ELSE 0 END AS BIGINT) AS psi
  FROM band LEFT JOIN adj ON w = width AND b = band)
"""

_WEIGHT_SQL = """
WITH raw AS (
  SELECT c_custkey, CASE WHEN c_custkey % 53 = 0 THEN 'heavy'
    ELSE CAST(80 + c_custkey % 221 AS VARCHAR) || '.' || CAST(c_custkey % 10 AS VARCHAR) || ' lbs' END AS t
  FROM customer),
num AS (
  SELECT c_custkey, TRY_CAST(NULLIF(regexp_extract(t, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS as_int,
    TRY_CAST(NULLIF(regexp_extract(t, '^\\s*([+-]?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS w
  FROM raw)
"""


def _fixed1_sql(x: str) -> str:
    """Exact one-decimal text; printf sends the exact ties at .25 down to .2, the rule sends them up."""
    return (
        f"CASE WHEN ({x}) * 4 = floor(({x}) * 4) AND CAST(({x}) * 4 AS BIGINT) % 4 = 1 "
        f"THEN printf('%d', CAST(floor({x}) AS BIGINT)) || '.3' ELSE printf('%.1f', {x}) END"
    )


def _tenths_sql(text: str) -> str:
    return f"CAST(replace({text}, '.', '') AS BIGINT)"


_CARB_SQL = (
    _WEIGHT_SQL
    + f""", c AS (SELECT c_custkey, w, {_fixed1_sql('w / 3')} AS carbs FROM num),
food(food, each) AS (VALUES ('banana', 27), ('gel', 23), ('taco', 14)),
per AS (
  SELECT c_custkey, food, {_fixed1_sql('CAST(carbs AS DOUBLE) / each')} AS pieces
  FROM c CROSS JOIN food)
"""
)

SQL = {
    "coerce_numeric": _WEIGHT_SQL + "SELECT c_custkey, as_int, w AS as_float FROM num",
    "weight_band": _PROFILE_SQL + "SELECT profile_id, band FROM scored",
    "psi_adjustment_lookup": _PROFILE_SQL + "SELECT profile_id, adjustment FROM scored",
    "psi_score": _PROFILE_SQL + "SELECT profile_id, psi FROM scored",
    "psi_score_csv": _PROFILE_SQL + "SELECT profile_id, psi FROM scored",
    "psi_message": _PROFILE_SQL
    + "SELECT profile_id, 'Your recommended tire PSI is ' || psi || '.' AS message FROM scored",
    "price_band": """
SELECT l_orderkey, l_linenumber, l_extendedprice, label AS reached
FROM lineitem ASOF LEFT JOIN (SELECT p_retailprice AS price, min(p_partkey) AS label FROM part GROUP BY p_retailprice)
  ON l_extendedprice >= price""",
    "psi_score_bands": _PROFILE_SQL
    + """, nations AS (
  SELECT n_name, n_nationkey AS k, 95 + 9 * n_nationkey + CASE WHEN n_nationkey % 2 = 1 THEN 1 ELSE 0 END AS least FROM nation),
banded AS (
  SELECT profile_id, width, tubeless, COALESCE(n_name, 'none') AS band, k
  FROM num ASOF LEFT JOIN nations ON total >= least)
SELECT profile_id, band, CAST(100 + CASE WHEN k IS NOT NULL AND width IN (23, 25, 28, 30, 32) THEN 2 * k - width ELSE -1 END
  - CASE WHEN tubeless THEN 10 ELSE 0 END AS BIGINT) AS psi
FROM banded""",
    "psi_score_rejects": _PROFILE_SQL
    + """, lines AS (
  SELECT profile_id, concat_ws(',', profile_id, riderweight, bikeweight, tirewidth, tubeless) AS whole,
    concat_ws(',', profile_id, riderweight, bikeweight) AS early
  FROM raw),
told AS (
  SELECT profile_id, CASE WHEN profile_id % 19 = 3 THEN early WHEN profile_id % 23 = 5 THEN whole || ',true'
    WHEN profile_id % 29 = 7 THEN 'no' || whole END AS damaged
  FROM lines)
SELECT CASE WHEN damaged IS NULL THEN profile_id END AS profile_id, CASE WHEN damaged IS NULL THEN psi END AS psi, damaged
FROM told JOIN scored USING (profile_id)""",
    "to_fixed_1": f"""
WITH t AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice / 3 * CASE WHEN l_orderkey % 89 = 0 THEN {2.0**50}::DOUBLE
    WHEN l_orderkey % 97 = 0 THEN {2.0**80}::DOUBLE ELSE 1 END AS x
  FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN x >= 1e21 THEN CAST(x AS VARCHAR)
  WHEN x >= 9e15 THEN CAST(CAST(x AS HUGEINT) AS VARCHAR) || '.0' ELSE {_fixed1_sql('x')} END AS rounded
FROM t""",
    "carb_plan": _CARB_SQL + f"SELECT c_custkey, {_tenths_sql('carbs')} AS carbs_tenths, carbs FROM c",
    "carb_food_equivalents": _CARB_SQL
    + f"SELECT c_custkey, food, {_tenths_sql('pieces')} AS pieces_tenths FROM per",
    "carb_message": _CARB_SQL
    + """, shown AS (
  SELECT c_custkey, COALESCE(any_value(carbs), 'NaN') AS carbs,
    COALESCE(max(CASE WHEN food = 'banana' THEN pieces END), 'NaN') AS bananas,
    COALESCE(max(CASE WHEN food = 'gel' THEN pieces END), 'NaN') AS gels,
    COALESCE(max(CASE WHEN food = 'taco' THEN pieces END), 'NaN') AS tacos
  FROM per JOIN c USING (c_custkey) GROUP BY c_custkey)
-- fixed wording of the recommendation
SELECT c_custkey, 'Your recommended number of carbs per hour is ' || carbs
  || '. You could get this amount of nutrition from ' || bananas || ' bananas, ' || gels
  || ' Gu gel packets, or ' || tacos || ' tacos per hour. (Don''t forget to take into account any carbs '
  || 'you''re getting from your sports drink or other supplements.)' AS message
FROM shown""",
}
