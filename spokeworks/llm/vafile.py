"""Exact nearest rows by inner product, with a vector-approximation file.

Every entry of a vector lies in one of 256 cells of its dimension, and the
approximation keeps the cell alone, one byte. From the ends of the cells follow
a lower and an upper bound of any inner product. A block of queries scans all
approximations and keeps, for each query, the rows whose upper bound reaches
the k-th best lower bound; exact vectors are then read in the order of the
bounds, until no row left can reach the k-th exact result.

Equal vectors give equal scores, and of those only the smallest ids can be
results, so a vector is kept k + 1 times at most: one more than results, as a
query's own row does not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.llm.tables import written
from spokeworks.llm.vectors import floored, usable_rows
from spokeworks.operators.joins import lookup_join

SCALE = 256
CELLS = 256
# Rows that the ends of the cells are fitted on at most, chosen by hash.
SAMPLE_ROWS = 4096
# Queries of one scan, on average; their vectors are sent to all tasks.
QUERY_BLOCK = 2048
# Rows whose bounds are computed at once.
TILE = 1024
# Exact vectors read first, for each result wanted.
FIRST_READ = 4


@dataclass(frozen=True)
class Cells:
    """Cell limits: `edges` (entries, CELLS - 1) begin the second and later cells, `low` and `high` are the least and largest entry of each."""

    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def size(self) -> int:
        return len(self.edges)

    @property
    def most(self) -> int:
        return int(max(abs(self.low.min()), abs(self.high.max())))

    def place(self, values: np.ndarray) -> np.ndarray:
        """Cell of every entry of (rows, entries)."""
        columns = [np.searchsorted(self.edges[d], values[:, d], side="right") for d in range(self.size)]
        return np.stack(columns, axis=1).astype(np.uint8)


def fit_cells(rows: DataFrame, scale: int) -> Cells | None:
    """Cells of equal width over the sampled entries of each dimension; the outer ones reach to the extremes of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = most = None
        for batch in batches:
            if batch.num_rows:
                values = floored(batch.column(0), scale)
                low, high = values.min(axis=0), values.max(axis=0)
                least = low if least is None else np.minimum(least, low)
                most = high if most is None else np.maximum(most, high)
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(least)), pa.int32()), pa.array(least), pa.array(most)], ["d", "lo", "hi"])

    extremes = rows.select("vec").mapInArrow(run, "d int, lo bigint, hi bigint")
    found = extremes.groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("parts")).orderBy("d").collect()
    if not found:
        return None
    if len({r.parts for r in found}) > 1:
        raise ValueError("vectors of several lengths in one table")
    sample = rows.orderBy(F.xxhash64("id", "vec"), "id").limit(SAMPLE_ROWS).select("vec").toArrow()
    values = floored(sample.column("vec").combine_chunks(), scale)
    least, most = (np.array([r[c] for r in found], np.int64) for c in ("lo", "hi"))
    # A sample's extremes keep a far entry from widening all cells.
    begin, end = values.min(axis=0).astype(object), values.max(axis=0).astype(object)
    steps = np.arange(1, CELLS, dtype=object)
    edges = np.array([b + (steps * (e - b + 1)) // CELLS for b, e in zip(begin, end, strict=True)], dtype=np.int64).reshape(len(found), -1)
    low = np.concatenate([least[:, None], edges], axis=1)
    high = np.concatenate([edges - 1, most[:, None]], axis=1)
    return Cells(edges, np.minimum(low, most[:, None]), np.maximum(high, least[:, None]))


def _int_type(most: int) -> np.dtype:
    return next(np.dtype(t) for t in ("i2", "i4", "i8") if most < np.iinfo(t).max)


def _bytes(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = matrix.shape[1] * matrix.itemsize
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(matrix))])


def _matrix(column: pa.Array, kind: np.dtype, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size)


def _quantised(rows: DataFrame, cells: Cells, scale: int, kind: np.dtype) -> DataFrame:
    """(id, vec, cells) with whole vectors and their cells as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = floored(batch.column(1), scale)
                yield pa.RecordBatch.from_arrays([batch.column(0), _bytes(values.astype(kind)), _bytes(cells.place(values))], ["id", "vec", "cells"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vec binary, cells binary")


def _scan(cells: Cells, queries: np.ndarray, ids: list, numbers: np.ndarray, k: int):
    """Task function: (query, row, own, lower, upper) of the rows of a part that may be among a query's k best."""
    # Bounds are exact as long as doubles hold the sums; else they are widened by more than rounding can do.
    limit = cells.size * cells.most * int(np.abs(queries).max(initial=0))
    slack = 0.0 if limit < 1 << 53 else limit * cells.size * 2.0**-50
    up, down = np.maximum(queries, 0).T.astype(float), np.minimum(queries, 0).T.astype(float)
    dims = np.arange(cells.size)
    at: dict = {}
    for place, own in enumerate(ids):
        at.setdefault(own, []).append(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((k, len(queries)), -np.inf)
        held, waiting = [], 0

        def reach():
            """Held rows that reach the k-th lower bound so far."""
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            keep = parts[4] >= best[0][parts[0]]
            return [x[keep] for x in parts]

        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                part = batch.slice(start, TILE)
                codes = _matrix(part.column(2), np.dtype("u1"), cells.size)
                low, high = cells.low[dims, codes].astype(float), cells.high[dims, codes].astype(float)
                upper = high @ up + low @ down + slack
                lower = low @ up + high @ down - slack
                own = np.zeros(upper.shape, bool)
                for place, name in enumerate(part.column(1).to_pylist()):
                    if name in at:
                        own[place, at[name]] = True
                # A row of the query's own id may be the query itself, which proves nothing.
                proof = np.concatenate([best, np.where(own, -np.inf, lower)])
                best = np.partition(proof, len(proof) - k, axis=0)[-k:]
                row, query = np.nonzero(upper >= best[0])
                rows = part.column(0).to_numpy()
                held.append((query, rows[row], own[row, query], lower[row, query], upper[row, query]))
                waiting += len(row)
                if waiting > 1 << 20:
                    held = [tuple(reach())]
                    waiting = len(held[0][0])
        if held:
            found = reach()
            found[0] = numbers[found[0]]
            names = ["query", "row", "own", "lower", "upper"]
            yield from pa.table(dict(zip(names, map(pa.array, found), strict=True))).to_batches(1 << 16)

    return run


def _score(queries: np.ndarray, ids: list, numbers: np.ndarray, kind: np.dtype):
    """Task function: exact scores of (query, row, id, vec), and whether the row equals the query in id and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place = np.searchsorted(numbers, batch.column(0).to_numpy())
                vectors = _matrix(batch.column(3), kind, queries.shape[1]).astype(np.int64)
                wanted = queries[place]
                equal = (vectors == wanted).all(axis=1)
                same = [bool(e) and ids[p] == name for e, p, name in zip(equal, place, batch.column(2).to_pylist(), strict=True)]
                scores = (vectors * wanted).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores), pa.array(same, pa.bool_())], ["query", "row", "id", "score", "same"])

    return run


def _block_results(vectors: DataFrame, cells: Cells, block: pa.Table, k: int, kind: np.dtype) -> DataFrame:
    """(query_id, rank, id, score) of one block of queries."""
    block = block.sort_by("no")
    numbers, ids = block.column("no").to_numpy(), block.column("id").to_pylist()
    queries = _matrix(block.column("vec").combine_chunks(), kind, cells.size).astype(np.int64)
    id_type = vectors.schema["id"].dataType.simpleString()
    scan = vectors.select("row", "id", "cells").mapInArrow(
        _scan(cells, queries, ids, numbers, k), "query bigint, row bigint, own boolean, lower double, upper double"
    )
    found = written(scan, "bounded")

    def kth(rows: DataFrame, value: str) -> DataFrame:
        """The k-th largest value of every query that has so many."""
        order = Window.partitionBy("query").orderBy(F.desc(value))
        best = rows.withColumn("_place", F.row_number().over(order)).filter(f"_place <= {k}")
        return best.groupBy("query").agg(F.min(value).alias("least"), F.count("*").alias("_n")).filter(f"_n = {k}").drop("_n")

    # One row for each query of the block.
    def reaching(rows: DataFrame, least: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(least), "query", "left").filter("least is null or upper >= least").drop("least")

    order = Window.partitionBy("query").orderBy(F.desc("upper"), "row")
    ranked = reaching(found, kth(found.filter("not own"), "lower")).withColumn("turn", F.row_number().over(order))
    ranked = written(ranked.select("query", "row", "own", "upper", "turn"), "ranked")

    def exact(rows: DataFrame, bounded: bool = False) -> DataFrame:
        wanted, held = rows.select("query", "row"), vectors.select("row", "id", "vec")
        # A bounded list goes to the vectors; a longer one is joined as its size suggests.
        pairs = held.join(F.broadcast(wanted), "row") if bounded else lookup_join(wanted, held, ["row"], "inner")
        scored = pairs.select("query", "row", "id", "vec").mapInArrow(
            _score(queries, ids, numbers, kind), f"query bigint, row bigint, id {id_type}, score bigint, same boolean"
        )
        return written(scored, "scored")

    # At most FIRST_READ * k rows for each query of the block.
    first = exact(ranked.filter(f"turn <= {FIRST_READ * k}"), bounded=True)
    own = ranked.filter("own").select("query", "row")
    certain = kth(first.join(own, ["query", "row"], "left_anti"), "score")
    rest = exact(reaching(ranked.filter(f"turn > {FIRST_READ * k}"), certain))
    copies = Window.partitionBy("query", "same").orderBy("row")
    scored = first.unionByName(rest).withColumn("_copy", F.row_number().over(copies)).filter("not same or _copy > 1")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}")
    named = pa.table({"query": block.column("no"), "query_id": block.column("id")})
    names = vectors.sparkSession.createDataFrame(named).select("query", F.col("query_id").cast(id_type).alias("query_id"))
    return best.join(F.broadcast(names), "query").select("query_id", "rank", "id", "score")


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner product with every query, ties to smaller ids.

    Entries become floor(scale * entry), and scores are exact integers. `queries`
    has the columns of `rows`; a row that equals a query in id and vector is
    taken to be the query's own and left out, once. Every query row is answered,
    also those that repeat an id. Rows and queries whose vector is null or
    empty, or holds a null, NaN or infinite entry, take no part. A row without
    id can be a result and comes last in a tie. With fewer than k candidates all
    are returned; an empty table gives none. Vectors of several lengths, and
    scores beyond 64 bits, end in a ValueError. Queries are answered in blocks of about
    `query_block`, one scan of all approximations each.
    """
    spark = rows.sparkSession
    base = usable_rows(rows, vec_id, vector)
    id_type = base.schema["id"].dataType.simpleString()
    asked = usable_rows(queries, vec_id, vector)
    cells = fit_cells(base.unionByName(asked), scale)
    if cells is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, {vec_id} {id_type}, score bigint")
    if cells.size * cells.most**2 >= 1 << 63:
        raise ValueError("inner products beyond 64 bits")
    kind = _int_type(cells.most)
    copies = Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last())
    kept = _quantised(base, cells, scale, kind).withColumn("_copy", F.row_number().over(copies)).filter(f"_copy <= {k + 1}").drop("_copy")
    vectors = written(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    numbered = _quantised(asked, cells, scale, kind).select("id", "vec").withColumn("no", F.monotonically_increasing_id())
    numbered = written(numbered, "queries")
    blocks = -(-numbered.count() // query_block)
    placed = numbered.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(max(blocks, 1))))
    placed = placed if blocks <= 1 else written(placed.repartition("block"), "query-blocks")
    out = spark.createDataFrame([], f"query_id {id_type}, rank int, id {id_type}, score bigint")
    for b in range(blocks):
        block = placed.filter(F.col("block") == b).drop("block").toArrow()
        if block.num_rows:
            out = out.unionByName(written(_block_results(vectors, cells, block, k, kind), "nearest"))
    return out.withColumnRenamed("id", vec_id)
