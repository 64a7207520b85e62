"""Visit counting on a stream, with all counts in Spark's own state.

Counts per key are a streaming aggregation: every task counts its hits first, so
a hot key sends one row per task to the state store. Totals are read from the
state itself. For ordinals the same query carries the hits beside the counts; a
micro-batch's hits are numbered like a batch table and continue from the total
the key had before. A repeated batch finds the state it began with and
overwrites its own `batch_id=N` folder, so every hit counts exactly once.
Counts never expire and no hit is dropped as late.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from spokeworks.operators.ordinal import HOT_KEY_ROWS, add_ordinal, key_counts
from spokeworks.workspace import scratch_table

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Stands in for the key where there is none.
_ALL = "__all"
# A hit of the batch, or the total of a key after it.
_HIT = "__hit"
_TOTAL = "__total"


def _batch_folder(root: str, batch_id: int) -> str:
    return f"{root}/batch_id={batch_id}"


@contextmanager
def _rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Keep state on disk, which suits many keys, unless the session names a provider."""
    named = spark.conf.get(_PROVIDER, None)
    if named is None:
        spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if named is None:
            spark.conf.unset(_PROVIDER)


def start_visit_totals(visits: DataFrame, keys: Sequence[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Running hits per key, held in Spark's state below `checkpoint` and nowhere else."""
    totals = visits.groupBy(*keys).agg(F.count("*").alias("visits"))
    # A query keeps the settings it started with.
    with _rocksdb_state(visits.sparkSession):
        return (
            totals.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )


def read_visit_totals(visits: DataFrame, keys: Sequence[str], checkpoint: str) -> DataFrame:
    """Total per key as of the last finished micro-batch, one row per key, from the state of `start_visit_totals`.

    `visits` lends its session and the keys' types. Before the first batch there are no totals.
    """
    spark = visits.sparkSession
    try:
        state = spark.read.format("statestore").load(checkpoint)
    except (AnalysisException, PySparkException) as error:
        if "STDS_COMMITTED_BATCH_UNAVAILABLE" not in str(error):
            raise
        fields = [visits.schema[key] for key in keys]
        return spark.createDataFrame([], StructType([*fields, StructField("visits", LongType())]))
    names = [F.col("key")[position].alias(name) for position, name in zip(state.schema["key"].dataType.names, keys)]
    return state.select(*names, F.col("value")["count"].alias("visits"))


def _hits_and_totals(visits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every hit, and the new total of every key that has one in the micro-batch."""
    hits = visits.select(F.struct(*visits.columns).alias(_HIT), *keys, F.lit(None).cast("bigint").alias(_TOTAL))
    totals = visits.groupBy(*keys).agg(F.count("*").alias(_TOTAL))
    return hits.unionByName(totals.select(F.lit(None).cast(hits.schema[_HIT].dataType).alias(_HIT), *keys, _TOTAL))


def start_visit_ordinals(
    visits: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    out: str,
    checkpoint: str,
    hot_key_rows: int = HOT_KEY_ROWS,
    **trigger,
) -> StreamingQuery:
    """Number every hit of the stream with the count it raised its key to.

    Within a micro-batch hits are numbered in `order_by` order, across batches
    in order of arrival. A batch is numbered like a batch table, so a hot key is
    spread over tasks instead of queueing in one state-store partition; the
    state gets a count per task and key. Without `keys` all hits are counted
    together.
    """
    if not keys:
        visits, keys = visits.withColumn(_ALL, F.lit(0)), [_ALL]

    def write(batch: DataFrame, batch_id: int) -> None:
        # Read once: every further reading of `batch` would run the state again.
        told = scratch_table(batch, "told", f"{checkpoint}/work")
        hits = told.filter(F.col(_TOTAL).isNull()).select(f"{_HIT}.*")
        totals = told.filter(F.col(_TOTAL).isNotNull()).select(*keys, _TOTAL)
        counted = scratch_table(key_counts(hits, keys), "counted", f"{checkpoint}/work")
        same = [counted[key].eqNullSafe(totals[key]) for key in keys]
        start = counted.join(totals, same).select(*(counted[key] for key in keys), (F.col(_TOTAL) - F.col("n")).alias("start"))
        numbered = add_ordinal(hits, order_by, keys, "visit_no", hot_key_rows, counted, start, f"{checkpoint}/work")
        numbered.drop(_ALL).write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    with _rocksdb_state(visits.sparkSession):
        return (
            _hits_and_totals(visits, keys)
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{checkpoint}/stream")
            .foreachBatch(write)
            .trigger(**trigger)
            .start()
        )
