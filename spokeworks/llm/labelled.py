"""Bounded samples of labelled documents that models are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spokeworks.llm.tables import held_out

# Labelled documents a model is fitted on at most, and bytes of their texts.
SAMPLE_DOCS = 6_000
SAMPLE_BYTES = 64 << 20


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    doc_id: str = "doc_id",
    text: str = "text",
    most: int = SAMPLE_DOCS,
    each: Column | None = None,
    most_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """(text, label) of labelled documents outside the held-out fifth, one row for each id.

    At most `most` ids are chosen by hash, and of those, in the order of the hash, the
    ones whose texts fit into `most_bytes` together. The choice is the same for every
    run and takes ids and sizes to the driver, never texts. `each` splits the
    choice: as many documents of either value. Labels without id or value are
    left out; an id labelled twice has the mean of its labels, and of several
    texts under one id the one with the smallest hash is taken.
    """
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id))
    means = known.groupBy(F.col(doc_id).alias("_id")).agg(F.avg(label).alias("label"))
    order = F.xxhash64("_id"), F.col("_id")
    if each is None:
        chosen = means.orderBy(*order).limit(most)
    else:
        half = most // 2
        chosen = means.filter(each).orderBy(*order).limit(half).unionByName(means.filter(~each).orderBy(*order).limit(half))
    # At most `most` rows: small enough to send.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    sizes = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), size.alias("n"))).alias("one"))
    picked, held = [], 0
    for row in sizes.select("_id", "one.h", "one.n").orderBy(*order).collect():
        if held + row.n <= most_bytes:
            held += row.n
            picked.append((row["_id"], row.h))
    picks = docs.sparkSession.createDataFrame(picked, StructType([StructField("_id", rows.schema["_id"].dataType), StructField("_h", LongType())]))
    own = rows.withColumn("_h", F.xxhash64("text")).join(F.broadcast(picks), ["_id", "_h"])
    return own.dropDuplicates(["_id"]).select("text", "label")
