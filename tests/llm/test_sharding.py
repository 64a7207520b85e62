import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spokeworks.llm import sharding


@pytest.mark.parametrize("buckets", [1, 50])
def test_equal_counts_and_mixture(small, buckets):
    docs = small("documents", "0.01")
    rows = sharding.interleave(docs, 24, buckets=buckets).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and len(rows) == docs.count()
    total = Counter(r.source for r in rows)
    share = Counter((r.source, r.shard) for r in rows)
    assert max(abs(share[s, i] - total[s] / 24) for s in total for i in range(24)) <= 2
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())


def test_buckets_change_nothing(hard_docs):
    one, many = (sorted(map(tuple, sharding.interleave(hard_docs, 5, buckets=n).collect()), key=repr) for n in (1, 8))
    assert one == many and len(one) == hard_docs.count()
    assert {r[2] for r in one if r[0] is None} == {8}


def test_seed_and_plan(small):
    docs = small("documents")
    a, b = ({r.doc_id: r.shard for r in sharding.interleave(docs, 8, seed=s).collect()} for s in (1, 2))
    assert a != b
    plan = sharding.interleave(docs, 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fewer_rows_than_shards_and_none(hard_docs):
    rows = sharding.interleave(hard_docs, 100).collect()
    assert len({r.shard for r in rows}) == len(rows) and {r.slot for r in rows} == {0}
    assert sharding.interleave(hard_docs.limit(0)).count() == 0


def test_sources_of_one_row_spread_over_shards(spark):
    rows = [(i, f"text {i}", "large" if i < 1200 else f"site{i}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    single = Counter(r.shard for r in sharding.interleave(docs, 24, buckets=24).collect() if r.source != "large")
    assert len(single) == 24 and max(single.values()) < 90


def test_every_place_against_plain_python(spark, small):
    """Shard and slot of each row by the rule, from the hashes that Spark gives."""
    docs = small("documents", "0.01")
    own = F.xxhash64(F.lit(17), F.col("source"), F.lit(False)).cast("double") / 2.0**64 + 0.5
    rows = docs.select("doc_id", "source", F.xxhash64(F.lit(17), "doc_id", "text").alias("h"), own.alias("u")).collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    placed = []
    for source, members in by_source.items():
        for rank, r in enumerate(sorted(members, key=lambda r: r.h)):
            placed.append(((rank + r.u) / len(members), source, r.h, r.doc_id))
    want, slots, n = {}, Counter(), len(rows)
    for g, (_, _, _, doc_id) in enumerate(sorted(placed)):
        shard = g * 24 // n
        want[doc_id] = (shard, slots[shard])
        slots[shard] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(docs, 24).collect()} == want


def test_equal_rows_part(spark):
    docs = spark.range(0, 20_000, 1, 4).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"), F.lit("one").alias("source"))
    rows = sharding.interleave(docs, 24)
    assert sorted(r.n for r in rows.groupBy("shard").agg(F.countDistinct("slot").alias("n")).collect()) == [833] * 16 + [834] * 8
