"""Connected components by repeated contraction along a pseudo-random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.tables import written
from spokeworks.operators.joins import lookup_join


def _place(node: str) -> Column:
    """A node's place in an order that has nothing to do with its id."""
    return F.struct(F.xxhash64(F.lit(29), node).alias("h"), F.col(node).alias("id"))


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def component_labels(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every linked node; the label is the smallest node of its component.

    In each round every node moves to the first node next to it, itself included, in
    an order by hash; links are rewritten between those, and loops and repeats go.
    A star takes two rounds, and a chain loses a good part of its nodes each time
    whatever the order of its ids, so rounds grow with the logarithm of its
    length. Nodes are followed through the rounds, and the smallest of each
    component is taken at the end. Tables stay in the shared folder; nothing but
    an emptiness test reaches the driver.
    """
    edges = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        first = _turned(edges).groupBy("a").agg(F.min(_place("b")).alias("m"))
        step = written(first.select(F.col("a").alias("node"), F.least("m", _place("a"))["id"].alias("label")), "steps")
        if labels is None:
            labels = step
        else:
            after = step.select(F.col("node").alias("label"), F.col("label").alias("_next"))
            labels = written(lookup_join(labels, after, ["label"], "left").select("node", F.coalesce("_next", "label").alias("label")), "labels")
        for column in ("a", "b"):
            moved = step.select(F.col("node").alias(column), F.col("label").alias("_to"))
            edges = lookup_join(edges, moved, [column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
        edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = written(edges.distinct(), "edges")
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return lookup_join(labels, least, ["label"], "inner").select("node", F.col("least").alias("label"))
