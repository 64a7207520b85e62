"""Proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash within their source and ranked there; the
fractional rank (rank - u) / size spreads every source evenly over (0, 1), where
u is the source's own seeded place in (0, 1), so that small sources do not meet;
sorted by it and cut into equal runs, every shard has the mixture of the whole.

Ranks never gather a source in one task: the order is cut into buckets at
sampled rows, rows are numbered inside a bucket and shifted by the buckets
before. Equal rows differ in the number they were written under, so they part too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.tables import written
from spokeworks.operators.joins import lookup_join
from spokeworks.operators.ordinal import number_rows


def interleave(
    docs: DataFrame,
    shards: int = 24,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 17,
    buckets: int | None = None,
) -> DataFrame:
    """Every row's place: (id, source, size, text_crc32, shard, slot); shards differ by one row at most.

    The size is the text's UTF-8 bytes plus 8; null counts as the empty text.
    Rows without source are a source of their own. Rows that agree in id and
    text are interchangeable; ties between sources at the same fractional rank
    go by source and hash. Other columns are not looked at.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    light = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.col(source), F.lit("")).alias("src"),
        F.col(source).isNull().alias("no_src"),
        (F.octet_length(body) + 8).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        F.xxhash64(F.lit(seed), F.col(doc_id), body).alias("h"),
    )
    rows = written(light.withColumn("copy", F.monotonically_increasing_id()), "rows")
    ranked = number_rows(rows, ["h", "id", "crc", "size", "copy"], ["src", "no_src"], "rank", buckets=buckets)
    totals = rows.groupBy("src", "no_src").agg(F.count("*").alias("total"))
    ranked = lookup_join(ranked, totals, ["src", "no_src"], "inner").withColumn("rank", F.col("rank") - 1)
    own = F.xxhash64(F.lit(seed), F.col("src"), F.col("no_src")).cast("double") / 2.0**64 + 0.5
    ranked = ranked.withColumn("fraction", (F.col("rank") + own) / F.col("total"))
    everything = written(ranked.select("id", "src", "no_src", "size", "crc", "h", "copy", "fraction"), "fractions")
    n = everything.count()
    ordered = number_rows(everything, ["fraction", "src", "no_src", "h", "id", "crc", "size", "copy"], name="g", buckets=buckets)
    ordered = ordered.withColumn("g", F.col("g") - 1)
    # Row g of n goes to the shard whose run holds it; the runs differ by one row at most.
    place = F.col("g").cast("bigint")
    n = max(n, 1)
    shard = F.expr(f"(g * {shards}) div {n}")
    first = F.expr(f"(((g * {shards}) div {n}) * {n} + {shards - 1}) div {shards}")
    return ordered.select(
        F.col("id").alias(doc_id),
        F.when(~F.col("no_src"), F.col("src")).alias(source),
        "size",
        F.col("crc").alias("text_crc32"),
        shard.cast("int").alias("shard"),
        (place - first).cast("bigint").alias("slot"),
    )
