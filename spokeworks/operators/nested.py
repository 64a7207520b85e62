"""Flattening of nested sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_sections(df: DataFrame, sections: str = "sections") -> DataFrame:
    """`array<struct<title, items array>>` to one row per item, with both positions.

    A section without items keeps one row with NULL item, as its title is still shown.
    """
    kept = [c for c in df.columns if c != sections]
    outer = df.select(*kept, F.posexplode(sections).alias("section_no", "_section"))
    return outer.select(
        *kept,
        "section_no",
        F.col("_section.title").alias("title"),
        F.posexplode_outer("_section.items").alias("item_no", "item"),
    )
