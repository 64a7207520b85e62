"""Carbohydrates per hour and their food equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeworks.functions import fixed1_tenths, fixed1_text, fixed1_value

# Fixed values of the nutrition rule: pounds per gram, grams per piece.
POUNDS_PER_GRAM = 3
FOOD_CARBS = {"banana": 27, "gel": 23, "taco": 14}

# Fixed wording of the recommendation.
_CARBS = "Your recommended number of carbs per hour is "
_BANANAS = ". You could get this amount of nutrition from "
_GELS = " bananas, "
_TACOS = " Gu gel packets, or "
_CLOSING = (
    " tacos per hour. (Don't forget to take into account any carbs you're getting from your "
    "sports drink or other supplements.)"
)


def with_carbs(riders: DataFrame, weight: str = "weight") -> DataFrame:
    """Add carbs per hour, from a double weight in pounds: rounded (`carbs_rounded`), as text, and in tenths.

    `carbs_tenths` is NULL from 9e17 grams on, where tenths exceed a bigint.
    """
    raw = riders.withColumn("_raw", F.col(weight) / POUNDS_PER_GRAM)
    x = F.col("_raw")
    return raw.withColumns(
        {"carbs_tenths": fixed1_tenths(x), "carbs": fixed1_text(x), "carbs_rounded": fixed1_value(x)}
    ).drop("_raw")


def pieces(carbs_rounded: Column, each: Column) -> Column:
    """Pieces of food that hold the already rounded carbs, unrounded."""
    return carbs_rounded / each


def food_equivalents(planned: DataFrame, foods: dict[str, int] = FOOD_CARBS) -> DataFrame:
    """One row per (rider, food) with the number of pieces as text (`pieces`) and in tenths."""
    menu = F.array(
        *(F.struct(F.lit(name).alias("food"), F.lit(float(each)).alias("each")) for name, each in foods.items())
    )
    return (
        planned.withColumn("_food", F.explode(menu))
        .withColumn("food", F.col("_food.food"))
        .withColumn("_pieces", pieces(F.col("carbs_rounded"), F.col("_food.each")))
        .withColumns({"pieces_tenths": fixed1_tenths(F.col("_pieces")), "pieces": fixed1_text(F.col("_pieces"))})
        .drop("_food", "_pieces")
    )


def with_carb_message(planned: DataFrame) -> DataFrame:
    """Add `message`, the sentence shown to the rider; 'NaN' stands for an unusable weight."""
    # Counts get columns of their own, as each appears several times in its text.
    counts = {f"_{food}": pieces(F.col("carbs_rounded"), F.lit(float(each))) for food, each in FOOD_CARBS.items()}
    food = {name: F.coalesce(fixed1_text(F.col(f"_{name}")), F.lit("NaN")) for name in FOOD_CARBS}
    message = F.concat(
        F.lit(_CARBS), F.coalesce("carbs", F.lit("NaN")), F.lit(_BANANAS), food["banana"], F.lit(_GELS),
        food["gel"], F.lit(_TACOS), food["taco"], F.lit(_CLOSING),
    )
    return planned.withColumns(counts).withColumn("message", message).drop(*counts)
