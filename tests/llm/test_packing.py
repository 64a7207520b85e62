import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spokeworks.llm import packing
from spokeworks.llm.queries import tokenizer_path
from spokeworks.operators import ordinal

from session_settings import settings


def check(docs, pieces, encode):
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for row in docs:
        ids = [*encode(row.text or ""), 1]
        own = sorted(by[row.doc_id], key=lambda p: p.start)
        distinct = {(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in own}
        at = 0
        for start, length, crc, total in sorted(distinct):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 2048
        padding += 2048 - at
    return padding / (2048 * max(len(sequences), 1))


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_all_tokens_once_with_little_padding(small, encode):
    docs = small("documents", "0.01")
    pieces = packing.pack(docs, tokenizer_path(), buckets=50).collect()
    assert check(docs.collect(), pieces, encode) < 0.02


def test_hard_rows(hard_docs, encode):
    docs = hard_docs.filter("doc_id is not null")
    pieces = packing.pack(docs, tokenizer_path()).collect()
    check(docs.collect(), pieces, encode)
    assert sum(p.doc_id == 5 for p in pieces) == 3
    assert packing.pack(hard_docs.filter("doc_id is null"), tokenizer_path()).count() == 2
    assert packing.pack(hard_docs.limit(0), tokenizer_path()).count() == 0


def test_both_vocabulary_files_give_the_same_ids(small, encode):
    quick = packing.load_encoder(tokenizer_path())
    texts = ["a <|endoftext|> b<|endoftext|>", "don't I'LL we've", "  \n\n\t x  ", "x́ \U0001f600 中文 ١٢٣ ²", "   ", "ſ'S" * 3, "a" * 5000]
    for text in texts + [r.text or "" for r in small("documents", "0.01").collect()]:
        assert quick(text) == encode(text)


RUNS = {"blanks": " " * 1_500_000, "lines": "\n" * 1_500_000, "both": " \n" * 600_000 + "x", "letters": "ab" * 600_000, "marks": "!?" * 600_000, "digits": "12" * 600_000}


@pytest.mark.parametrize("kind", list(RUNS))
def test_long_runs_are_packed(spark, encode, kind):
    """The quick tokenizer gives up on some of these, the named one does not."""
    text = f"a {RUNS[kind]} b"
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    check(docs.collect(), packing.pack(docs, tokenizer_path()).collect(), encode)


def test_equal_rows_part(spark, encode):
    """A table of one row, repeated, is ranked in many tasks."""
    docs = spark.range(0, 20_000, 1, 4).select(F.lit(7).alias("doc_id"), F.lit("the same text").alias("text"))
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        packed = packing.pack(docs, tokenizer_path()).persist()
        assert check([docs.first()], packed.limit(300).collect(), encode) >= 0
        size = len(encode("the same text")) + 1
        full = packed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("places"), F.max("offset").alias("last"))
        assert packed.count() == 20_000 and full.filter(f"n <> places or last <> (n - 1) * {size}").isEmpty()
        packed.unpersist()
        rows = docs.withColumns({"h": F.lit(1), "copy": F.monotonically_increasing_id()})
        runs = ordinal.bucket_runs(rows, ordinal.fit_splitters(rows, ["h", "copy"]))
        sizes = [r.n for r in runs.collect()]
        assert len(sizes) > 16 and max(sizes) < 4_000


def test_ids_on_request(spark, encode):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    rows = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {1: [*encode("some words"), 1], 2: [1]}


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece(seed):
    draw = np.random.default_rng(seed)
    histogram = draw.integers(0, (1, 5, 400, 90_000)[seed], 257)
    histogram[0] = 0
    used = np.zeros(257, np.int64)
    for parts, times in packing.plan_windows(histogram):
        assert times > 0 and sum(c * m for c, m in parts.items()) <= 256
        for c, m in parts.items():
            used[c] += m * times
    assert (used == histogram).all()


def test_least_squares():
    draw = np.random.default_rng(3)
    a = draw.integers(0, 3, (20, 60)).astype(float)
    truth = np.maximum(draw.normal(size=60), 0) * (draw.random(60) < 0.2)
    x = packing.non_negative_least_squares(a, a @ truth)
    assert (x >= 0).all() and np.abs(a @ x - a @ truth).max() < 1e-6
