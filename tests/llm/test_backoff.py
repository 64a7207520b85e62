import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeworks.llm import backoff


def brute_force(rows):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for _, t in rows]
    grams = [[Counter(tuple(w[i - n + 1 : i + 1]) for i in range(n - 1, len(w))) for n in range(1, 4)] for w in docs]
    whole = [sum((g[n] for g in grams), Counter()) for n in range(3)]
    size = sum(map(len, docs))
    out = []
    for (name, _), w, own in zip(rows, docs, grams):
        total = 0.0
        count = lambda g: whole[len(g) - 1][g] - own[len(g) - 1][g] if g else size - len(w)
        for i in range(len(w)):
            steps = 0
            for n in (3, 2, 1):
                gram = tuple(w[max(i - n + 1, 0) : i + 1])
                if len(gram) == n and count(gram) > 0:
                    total += steps * math.log(0.4) + math.log(count(gram) / count(gram[:-1]))
                    break
                steps += 1
            else:
                total += 3 * math.log(0.4) - math.log(size - len(w) + 1)
        out.append((name, len(w), total))
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 20_000, "range_bytes": 60_000}])
def test_against_brute_force(small, hard_docs, sizes):
    docs = hard_docs.filter("length(text) < 5000 or text is null").select("doc_id", "text", "block", "range")
    more = small("documents").selectExpr("doc_id + 1000 AS doc_id", "text", "'' AS block", "'' AS range").limit(60)
    docs = docs.unionByName(more).persist()
    rows = docs.select("doc_id", "text").collect()
    got = sorted(backoff.lm_scores(docs, **sizes).collect(), key=lambda r: (repr(r.doc_id), r.log_score))
    want = sorted(brute_force(rows), key=lambda r: (repr(r[0]), r[2]))
    docs.unpersist()
    assert [(r.doc_id, r.n_words) for r in got] == [w[:2] for w in want]
    for r, w in zip(got, want):
        assert r.log_score == pytest.approx(w[2], rel=1e-9, abs=1e-9)
        assert (r.mean_log_score is None) == (r.n_words == 0)


@pytest.mark.parametrize("ranges", [1, 7, 1000, 10**6])
def test_rows_follow_the_grams(ranges):
    """A block has no more rows than n-grams, however many ranges there are."""
    hashes = np.unique(np.random.default_rng(ranges).integers(0, 2**64, 300, dtype=np.uint64))
    rows, cuts = backoff._cuts(hashes, ranges)
    assert len(rows) == len(cuts) - 1 <= min(ranges, 300) and rows == sorted(set(rows)) and cuts[-1] == len(hashes)
    for r, a, b in zip(rows, cuts, cuts[1:]):
        assert a < b and {(int(h) >> 32) * ranges >> 32 for h in hashes[a:b]} == {r}
    assert backoff._cuts(hashes[:0], ranges)[0] == []


def test_equal_rows_part_into_blocks(spark):
    docs = spark.range(0, 6_000, 1, 4).select(F.lit(1).alias("doc_id"), F.lit("one row again").alias("text"))
    frame = backoff.lm_scores(docs, block_bytes=3_000)
    assert frame.count() == 6_000 and frame.select("log_score").distinct().count() == 1
    keyed = docs.withColumn("b", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(26)))
    assert max(r["count"] for r in keyed.groupBy("b").count().collect()) < 400


def test_empty_and_long(hard_docs):
    assert backoff.lm_scores(hard_docs.limit(0)).count() == 0
    assert max(r.n_words for r in backoff.lm_scores(hard_docs).collect()) == 120_000
