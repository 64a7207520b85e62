"""Words and 64-bit hashes over the UTF-8 bytes of Arrow batches, without a Python loop per word.

Texts are taken in slices of a bounded number of bytes, so the arrays below stay
small whatever the batch; only a single text longer than that makes a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(members) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[list(members)] = True
    return flags


# Lower-cased ASCII letters, digits and every byte of a character outside ASCII.
ALNUM = _table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
# Anything but ASCII white space.
SOLID = ~_table([0x20, *range(0x09, 0x0E)])

_seeds = np.random.default_rng(20_24)
_BYTE_CODES = _seeds.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold at most `most` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if batch.num_rows > start:
        yield batch.slice(start)


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offset; null is the empty text."""
    texts = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word (run of member bytes within a row), and words per row."""
    inside = members[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins = inside & ~before[:-1]
    begins[edges] = inside[edges]
    stops = inside & ~after[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = inside[last]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) - starts + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, lengths, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word; it depends on the word's bytes alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = int(lengths.sum())
    firsts = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=firsts[1:])
    place = np.arange(total, dtype=np.int64) - np.repeat(firsts, lengths)
    at = place + np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()), _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    return mix64(np.add.reduceat(_BYTE_CODES[data[at]] * powers[place], firsts))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; none if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix64(out * _BASE + words[k : len(words) - n + 1 + k])
    return out
