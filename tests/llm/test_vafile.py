"""Exact search against brute force over hot vectors, ties, repeated rows and hard rows."""

import math
import random

import pytest

from spokeworks.llm import vafile

SCHEMA = "vec_id bigint, embedding array<float>, row string, query string, score string"


def brute(rows, queries, k, scale=256):
    """Rows by number, so that a query's own row is left out and rows of the same id are not."""
    ints = [(i, None if v is None or any(c is None or not math.isfinite(c) for c in v) or not v else [math.floor(scale * c) for c in v]) for i, v in rows]
    out = []
    for q in queries:
        if ints[q][1] is None:
            continue
        scored = [(-sum(a * b for a, b in zip(ints[q][1], v)), i is None, i or 0, i) for at, (i, v) in enumerate(ints) if at != q and v is not None]
        for rank, (score, _, _, name) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1):
            out.append((ints[q][0], rank, name, -score))
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("kind", ["random", "hot", "few values", "outlier"])
@pytest.mark.parametrize("block", [2048, 7])
def test_equals_brute_force(spark, kind, block):
    rng = random.Random(kind)
    rows = []
    for i in range(400):
        v = [round(rng.gauss(0, 0.3), 3) for _ in range(6)]
        if kind == "hot" and i % 3 == 0:
            v = [0.5, -0.25, 0.125, 0.0, 0.0, 1.0]
        if kind == "few values":
            v = [float(rng.randint(-1, 1)) for _ in range(6)]
        if kind == "outlier" and i == 77:
            v = [5000.0, -3000.0, 0.0, 0.0, 0.0, 1e6]
        rows.append((i % 390, v))
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(6)
    exact = [(r.vec_id, r.embedding) for r in frame.collect()]
    queries = [i for i, r in enumerate(exact) if r[0] % 10 == 0]
    assert found(vafile.search(frame, frame.filter("vec_id % 10 = 0"), 5, query_block=block)) == brute(exact, queries, 5)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (50, None), (50, []), (50, [nan, 1.0]), (100, [inf, 1.0]), (None, [9.0, 9.0]), (1, [1.0, None]), (150, [-1.0, -0.001]), (None, None), (7, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)
    exact = [(r.vec_id, r.embedding) for r in frame.collect()]
    queries = [i for i, r in enumerate(exact) if r[0] is not None and r[0] % 50 == 0]
    asked = frame.filter("vec_id % 50 = 0")
    assert found(vafile.search(frame, asked, 3)) == brute(exact, queries, 3)
    # Fewer candidates than results.
    assert found(vafile.search(frame, asked, 50)) == brute(exact, queries, 50)
    assert vafile.search(frame.limit(0), frame.limit(0)).count() == 0
    assert vafile.search(frame, frame.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    one = spark.createDataFrame([(50, [1.0])], "vec_id int, embedding array<double>")
    assert vafile.search(one, one).count() == 0


def test_approximations_rule_most_rows_out(spark, small):
    """Of all rows of sf0.1 few are read exactly for a query, and bounds hold."""
    import numpy as np

    rows = vafile.usable_rows(small("embeddings", "0.1"), "vec_id", "embedding")
    cells = vafile.fit_cells(rows, 256)
    values = vafile.floored(rows.toArrow().column("vec").combine_chunks(), 256)
    codes, dims = cells.place(values), np.arange(cells.size)
    low, high = cells.low[dims, codes], cells.high[dims, codes]
    assert (low <= values).all() and (values <= high).all()
    query = values[:20]
    upper = high @ np.maximum(query, 0).T + low @ np.minimum(query, 0).T
    lower = low @ np.maximum(query, 0).T + high @ np.minimum(query, 0).T
    exact = values @ query.T
    assert (lower <= exact).all() and (exact <= upper).all()
    assert ((upper >= np.sort(lower, axis=0)[-6]).sum(axis=0) < 60).all()
