"""Stupid-backoff language-model scores, computed relationally.

    S(w | u v) = c(u v w) / c(u v)            if c(u v w) > 0
                 0.4 * c(v w) / c(v)          else if c(v w) > 0
                 0.4^2 * c(w) / N             else if c(w) > 0
                 0.4^3 / (N + 1)              else

Counts are those of the whole corpus without the document that is scored, so
that a document does not vouch for itself. Relations hold n-grams as 64-bit
hashes. Rows are packed: documents are dealt into blocks of bounded size; a
block's distinct n-grams of one hash range are one row of the count relation,
partitioned by that range. Every range sums its n-grams over all blocks and
answers each block's row with the totals, which are joined back to the block
and summed per document. The texts are shuffled once, for both uses. As a block
sends an n-gram once, however often it holds it, no n-gram is hot.

A block has a row for each range that it has n-grams of: at most as many as
ranges, and never more than its n-grams. So while the corpus is small next to
BLOCK_BYTES * n-grams of a block, rows grow with the square of it, each of them
shorter; from there on they grow in proportion, as rows of single n-grams would.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.textbytes import SOLID, gram_hashes, lowered, text_slices, utf8_bytes, word_hashes, word_spans

ORDER = 3
BACKOFF = 0.4
# Bytes of text in a block, and in all that one range of hashes comes from.
BLOCK_BYTES = 12 << 20
RANGE_BYTES = 8 << 20
HASH_BYTES = 1 << 20


def document_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z lower-cased), and words per text."""
    hashes, counts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(offsets) - 1:  # a slice at a time, as hashing takes many times a text's size
        end = max(int(np.searchsorted(offsets, offsets[at] + HASH_BYTES, side="right")) - 1, at + 1)
        data = lowered(raw[offsets[at] : offsets[end]])
        starts, lengths, n = word_spans(data, offsets[at : end + 1] - offsets[at], SOLID)
        hashes.append(word_hashes(data, starts, lengths))
        counts.append(n)
        at = end
    return np.concatenate(hashes), np.concatenate(counts)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, 0):
            data, offsets = utf8_bytes(part.column(0))
            starts, _, _ = word_spans(data, offsets, SOLID)
            yield pa.RecordBatch.from_arrays([pa.array([len(data)], pa.int64()), pa.array([len(starts)], pa.int64())], ["bytes", "words"])


def block_grams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each word, and whether it lies within one text."""
    hashes = np.zeros(len(words), np.uint64)
    hashes[n - 1 :] = gram_hashes(words, n)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    # Different lengths must not share hashes.
    return hashes ^ np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1)), place >= n - 1


def _squeeze(values: np.ndarray) -> bytes:
    """64-bit values by their bytes, low ones first, so that zeros gather; compressed."""
    planes = np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def _expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack(hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes as their differences."""
    return _squeeze(np.diff(hashes, prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data), dtype=np.uint64)


def _all_grams(words: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """Hashes of all n-grams of a block up to `order`."""
    return np.concatenate([h[whole] for h, whole in (block_grams(words, counts, n) for n in range(1, order + 1))])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, block) as one row for each block of a batch, its texts compressed together."""
    for batch in batches:
        blocks = batch.column(2).to_numpy()
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order], prepend=-1)) if len(blocks) else []
        rows = []
        for own in np.split(order, cuts[1:]) if len(blocks) else []:
            part = batch.take(pa.array(own))
            data, offsets = utf8_bytes(part.column(1))
            rows.append((int(blocks[own[0]]), part.column(0), np.diff(offsets), zstandard.ZstdCompressor(6).compress(data.tobytes())))
        ids = [r[1] for r in rows]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.ListArray.from_arrays(pa.array(starts), pa.concat_arrays(ids) if ids else batch.column(0)),
                pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                pa.array([r[3] for r in rows], pa.binary()),
            ],
            ["block", "ids", "sizes", "data"],
        )


def _gather(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of all texts of a block."""
    sizes = np.concatenate([np.asarray(x) for x in table.column("sizes").to_pylist()]).astype(np.int64)
    data = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table.column("data").to_pylist())
    ids = pa.concat_arrays([chunk.flatten() for chunk in table.column("ids").chunks])
    return ids, np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Which of `ranges` equal ranges the high half of each hash lies in, ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _cuts(hashes: np.ndarray, ranges: int) -> tuple[list[int], np.ndarray]:
    """The ranges that sorted hashes lie in, and where each begins, and the end; the work follows the hashes."""
    own = _range_of(hashes, ranges)
    begins = np.flatnonzero(np.diff(own, prepend=np.uint64(2**64 - 1)) != 0) if len(own) else np.zeros(0, np.int64)
    return own[begins].astype(np.int64).tolist(), np.append(begins, len(hashes))


def lm_scores(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """(id, n_words, log_score, mean_log_score) for each row; natural logarithms.

    `log_score` sums over the words; the mean is null for a text without words.
    Null and empty texts have no words and score 0. A repeated row is a
    document of its own, so its copy vouches for it. Other columns are not
    looked at.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    body = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    measured = body.select("text").mapInArrow(_measure, "bytes bigint, words bigint").agg(F.sum("bytes"), F.sum("words")).first()
    size, corpus = measured[0] or 0, measured[1] or 0
    blocks = max(-(-size // block_bytes), 1)
    ranges = max(-(-size * order // range_bytes), 1)
    # The row's own number parts equal rows, which would fill one block.
    dealt = body.withColumn("block", F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(blocks)))
    dealt = dealt.mapInArrow(_deal, f"block bigint, ids array<{id_type}>, sizes array<bigint>, data binary")

    def extract(table: pa.Table) -> pa.Table:
        _, data, offsets = _gather(table)
        keys = _all_grams(*document_words(data, offsets), order)
        hashes, n = np.unique(keys, return_counts=True)
        rows, cuts = _cuts(hashes, ranges)
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(rows), pa.int64()),
                "range": pa.array(rows, pa.int64()),
                "grams": pa.array([_pack(hashes[a:b]) for a, b in pairwise(cuts)], pa.binary()),
                "counts": pa.array([_squeeze(n[a:b]) for a, b in pairwise(cuts)], pa.binary()),
            }
        )

    def total(table: pa.Table) -> pa.Table:
        grams = [_unpack(x.as_py()) for x in table.column("grams")]
        counts = np.concatenate([_expand(x.as_py()) for x in table.column("counts")]).astype(np.int64)
        _, at = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.bincount(at, counts).astype(np.int64)
        # What other blocks have, mostly nothing.
        rest = np.split(sums[at] - counts, np.cumsum([len(g) for g in grams])[:-1])
        return pa.table({"block": table.column("block"), "range": table.column("range"), "rest": pa.array([_squeeze(x) for x in rest], pa.binary())})

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, data, offsets = _gather(texts)
        words, counts = document_words(data, offsets)
        by_range = dict(zip(answers.column("range").to_pylist(), answers.column("rest").to_pylist()))
        rest = np.concatenate([_expand(by_range[r]) for r in sorted(by_range)]).astype(np.int64) if by_range else np.zeros(0, np.int64)
        logs = _word_logs(words, counts, rest, corpus, order)
        sums = np.bincount(np.repeat(np.arange(len(counts)), counts), logs, len(counts))
        mean = [float(s / c) if c else None for s, c in zip(sums, counts)]
        return pa.table({"id": ids, "n_words": pa.array(counts, pa.int64()), "log_score": pa.array(sums), "mean_log_score": pa.array(mean, pa.float64())})

    grams = dealt.groupBy("block").applyInArrow(extract, "block bigint, `range` bigint, grams binary, counts binary")
    answers = grams.groupBy("range").applyInArrow(total, "block bigint, `range` bigint, rest binary")
    schema = f"id {id_type}, n_words bigint, log_score double, mean_log_score double"
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
    return scored.withColumnRenamed("id", doc_id)


def _word_logs(words: np.ndarray, counts: np.ndarray, rest: np.ndarray, corpus: int, order: int) -> np.ndarray:
    """Log of every word's score, by counts of the corpus without the word's own document.

    `rest` holds the counts in other blocks of the block's distinct n-grams, in
    the order of their hashes.
    """
    if not len(words):
        return np.zeros(0)
    row = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    others = np.zeros((order + 1, len(words)), np.int64)  # counts elsewhere of the n-gram that ends here
    others[0] = corpus - counts[row]
    keys = _all_grams(words, counts, order)
    hashes, here = np.unique(keys, return_counts=True)
    del keys
    for n in range(1, order + 1):  # one order at a time, to hold less
        grams, whole = block_grams(words, counts, n)
        ends = np.flatnonzero(whole)
        at = np.searchsorted(hashes, grams[ends])
        # Occurrences in the own document; an n-gram that the block holds once is there once.
        own = np.ones(len(ends), np.int64)
        several = np.flatnonzero(here[at] > 1)
        pair = (row[ends[several]].astype(np.uint64) << np.uint64(40)) | at[several].astype(np.uint64)
        _, place, times = np.unique(pair, return_inverse=True, return_counts=True)
        own[several] = times[place]
        others[n, ends] = rest[at] + here[at] - own
    # The context of an n-gram is the (n-1)-gram that ends one word earlier, in the same text.
    logs = np.full(len(words), order * np.log(BACKOFF)) - np.log(others[0] + 1)
    for n in range(1, order + 1):
        context = others[0] if n == 1 else np.concatenate([[0], others[n - 1, :-1]])
        hit = others[n] > 0
        logs[hit] = (order - n) * np.log(BACKOFF) + np.log(others[n][hit]) - np.log(context[hit])
    return logs
