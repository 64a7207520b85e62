"""Bit-plane statistics and whitening against plain integers and numpy."""

import math
import random

import numpy as np
import pytest

from spokeworks.llm import whitening
from spokeworks.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, n string, i string, vec string"
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("scale", [0, 1, 300, 10**6, 2**40])
def test_block_products_are_exact(scale):
    rng = random.Random(scale)
    rows = [[rng.randint(-scale, scale) for _ in range(5)] for _ in range(130)]
    for row in rows:
        row[3] = 7  # a dimension without variance
    sums, products = whitening.block_products(np.array(rows, np.int64))
    assert sums.tolist() == [sum(c) for c in zip(*rows)]
    assert products.tolist() == [[sum(r[a] * r[b] for r in rows) for b in range(5)] for a in range(5)]


def _expected(vectors, components=32):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[n * a - s for a, s in zip(row, sums)] for row in x], object)
    cov = np.array([[sum(a * b for a, b in zip(p, q)) / n**3 for q in centred.T] for p in centred.T], float)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    white = (centred.astype(float) / n) @ axes[:, order] / np.sqrt(values[order])
    return n, (centred * centred).sum(axis=1), white, values[order] / values.sum()


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_query_matches_numpy(spark, folder):
    found = QUERIES["op11_whitening"](spark, folder).toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, explained = _expected([r.embedding for r in table])
    assert len(found) == 32 * n and set(found.n) == {n}
    assert found.vec_id.tolist() == [r.vec_id for r in table for _ in range(32)]
    assert found.component.tolist() == list(range(1, 33)) * n
    assert found.deviation.tolist()[::32] == deviation.tolist()
    got = found.whitened.to_numpy().reshape(n, 32)
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-6
    assert np.abs(found.explained.to_numpy()[:32] / explained - 1).max() < 1e-9
    assert set(found.identity_error) == {found.identity_error.iloc[0]} and found.identity_error.iloc[0] < 1e-9
    assert np.abs(got.T @ got / n - np.eye(32)).max() < 1e-9


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(3)
    good = [[rng.gauss(0, 1), rng.gauss(0, 3), 0.5, 1e5 * rng.random()] for _ in range(90)]
    rows = [(i, v) for i, v in enumerate(good)] + [(7, good[7]), (7, good[7]), (None, good[0])]
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0]), (203, [nan, 0.0, 0.0, 0.0]), (204, [0.0, -inf, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows + bad], SCHEMA).repartition(5)
    found = whitening.whiten(frame, components=8).collect()
    assert sorted(str(r.vec_id) for r in found) == sorted(str(r[0]) for r in rows)
    kept = [r.embedding for r in frame.collect() if r.vec_id is None or r.vec_id < 200]
    n, deviation, _, explained = _expected(kept, 3)
    assert {r.n for r in found} == {n} == {93}
    assert sorted(int(r.deviation) for r in found) == sorted(deviation)
    # One of four dimensions is constant.
    assert all(len(r.whitened) == 3 for r in found) and np.allclose(found[0].explained, explained)
    assert found[0].identity_error < 1e-4
    assert whitening.whiten(frame.filter("vec_id >= 200")).count() == 0
    assert whitening.whiten(frame.limit(0)).columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    alone = whitening.whiten(frame.filter("vec_id = 3")).collect()
    assert [(r.vec_id, r.n, int(r.deviation), r.whitened) for r in alone] == [(3, 1, 0, [])]
    with pytest.raises(Exception, match="several|entries in one table"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<double>")).collect()


def test_wide_entries_stay_exact(spark):
    rows = [(i, [float(2**50 + i * i), float(-i)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    n, deviation, _, _ = _expected([r[1] for r in rows], 2)
    assert sorted(int(r.deviation) for r in whitening.whiten(frame).collect()) == sorted(deviation)
