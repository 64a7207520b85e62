"""A training corpus from raw documents: quality, toxicity, near-duplicates, contamination, packing.

Every stage takes (spark, docs, folder of the given tables) and returns a frame.
The first four return documents with the columns they had; the last one returns
pieces of packed sequences. `run` writes each stage's rows to the shared folder,
reads them back for the next, and deletes what is no longer needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeworks.llm import attention, decontaminate, neardup, packing, severity
from spokeworks.llm.queries import tokenizer_path
from spokeworks.llm.tables import free_name, table, written
from spokeworks.operators.joins import lookup_join
from spokeworks.workspace import job, release, scratch_path

# Benchmark passages of more words are cut from documents that stay; None leaves texts as they are.
CUT_LONGER_THAN: int | None = None


def _chosen(docs: DataFrame, verdicts: DataFrame, condition: str, doc_id: str = "doc_id") -> DataFrame:
    """Rows of `docs` whose id has no verdict, or one that meets the condition; null ids stay.

    Only ids that go are joined, and repeated rows share their verdict.
    """
    out = written(verdicts.filter(f"NOT ({condition})").select(doc_id).filter(f"{doc_id} IS NOT NULL").distinct(), "gone")
    if out.count() <= neardup.BROADCAST_IDS:
        out = F.broadcast(out)
    return docs.join(out, doc_id, "left_anti").select(*docs.columns)


def _single(docs: DataFrame) -> DataFrame:
    """`docs` with one row of those that agree in id and text; which one, if other columns differ, is open.

    Of rows without id one stays for each text, and none if a row with an id has
    that text. Rows without id and words are copies of nothing, and all stay.
    Only the rows of repeated texts are shuffled whole.
    """
    copy = free_name(docs, "copy")
    no_id = F.col("doc_id").isNull()
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    digest = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("-" * 64))
    bare = F.concat(F.lit("?"), digest)  # no id
    named = F.concat(F.col("doc_id").cast("string"), F.lit("="), digest)
    keyed = docs.withColumn(copy, F.when(~no_id, named).when(words, bare))
    groups = keyed.filter(F.col(copy).isNotNull()).groupBy(copy).agg(F.count("*").alias("n"))
    again = written(groups.filter("n > 1").select(copy), "repeated")
    loose = written(docs.filter(no_id & words).select(bare.alias(copy)).distinct(), "without-id")
    taken = loose.limit(0)
    if not loose.isEmpty():
        owned = docs.filter(~no_id).select(bare.alias(copy)).distinct()
        taken = written(loose.join(owned, copy, "left_semi"), "taken")
    if again.isEmpty() and taken.isEmpty():
        return docs
    several = written(again.join(taken, copy, "left_anti"), "several")
    rest = lookup_join(keyed, again.unionByName(taken).distinct(), [copy], "left_anti")
    once = lookup_join(keyed, several, [copy], "left_semi").dropDuplicates([copy])
    return rest.unionByName(once).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it learns from those that carry labels."""
    return attention.score(docs, attention.train(docs, table(spark, folder, "labels")), keep=True)


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the severity model does not find toxic."""
    return severity.score(docs, severity.train(docs, table(spark, folder, "labels")), keep=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of every class of near-duplicates, once; see `_single` for rows without id."""
    return _chosen(_single(docs), neardup.near_duplicates(docs, shingle=3, percent=85), "kept")


def decontamination(spark: SparkSession, docs: DataFrame, folder: str, cut_longer_than: int | None = CUT_LONGER_THAN) -> DataFrame:
    """Documents of whose words less than one in twenty lies in a benchmark passage, each judged by its own text.

    With `cut_longer_than` passages of more words than that are cut from the documents that stay.
    """
    return decontaminate.keep_clean(docs, table(spark, folder, "benchmark"), cut_longer_than=cut_longer_than)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

# Models are trained on the way, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in order, from the documents of a folder."""
    docs, before = table(spark, folder, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with job(spark, name):  # what the stage writes on its way goes with it
            stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            release(spark, before)
        before = path
    return docs
