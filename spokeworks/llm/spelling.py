"""Spelling variants: words one edit apart, found by scanning sorted vocabularies.

Of two words one edit apart, either the first half of a word or the second is
untouched. So every word meets its near words in the vocabulary sorted forward,
among those that begin with its first half, or in the vocabulary of reversed
words, among those that end with its second half.

A scan goes through a sorted range of candidates with a block of words at once.
Candidates that share a prefix lie together, and the adjacent LCPs say which;
the row of the edit matrix for that prefix, three cells around the diagonal, is
computed once per word and reused for all of them. A range whose shared prefix
already exceeds one edit is left out whole, within a task and before words are
sent to one.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.tables import written
from spokeworks.operators.joins import lookup_join

LEAST_LETTERS = 7
LEAST_COUNT = 2
# A form has to be so many times as frequent.
RATIO = 10
# One run in so many loses a letter.
ERRORS = 31
# Words a task counts before it hands its counts on.
HELD_WORDS = 250_000
# Candidates of one sorted range, and words that scan it at once.
RANGE_WORDS = 25_000
SCAN_WORDS = 8_192
# Letters of a range's first and last word that are told to all tasks.
SHOWN = 48

_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_CAPITALS = bytes(range(0x41, 0x5B))
_LOWER = bytes.maketrans(_CAPITALS, _CAPITALS.lower())


def run_counts(text: str, doc_id: object) -> Counter:
    """Counts of a text's lower-cased runs, in UTF-8, after the deletions that belong to this document."""
    runs = Counter(_LETTERS.findall(text.encode().translate(_LOWER)))
    if doc_id is None:
        return runs
    seed, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run, seed)
        if h % ERRORS == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        out[run] += n
    return out


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; counts are combined in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = [word.decode() for word in held]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            long = pa.array([len(word) >= least_letters for word in words], pa.bool_())
            held.clear()
            return out.filter(long)

        for batch in batches:
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in run_counts(body.as_py(), own).items():
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).filter("body is not null")
    counted = texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


@dataclass(frozen=True)
class Words:
    """Words of one byte a letter, one after the other."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Words:
        lengths = np.array([len(w) for w in words], np.int64)
        # Two letters that no word has follow the last one, for looks past its end.
        data = np.frombuffer("".join(words).encode("latin-1") + b"\0\0", np.uint8)
        return cls(data, np.cumsum(lengths) - lengths, lengths)

    def letter(self, rows: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """Letter at a position of each word, 0 where it has none."""
        inside = (at >= 0) & (at < self.lengths[rows])
        return np.where(inside, self.data[np.where(inside, self.starts[rows] + at, 0)], 0)


def adjacent_lcps(words: Words) -> np.ndarray:
    """Letters that each word of a sorted list shares with the one before; -1 for the first."""
    out = np.full(len(words.lengths), -1, np.int64)
    alike, depth = np.arange(1, len(out)), 0
    while len(alike):
        mine = words.letter(alike, depth)
        same = (mine == words.letter(alike - 1, depth)) & (mine > 0)
        out[alike[~same]] = depth
        alike, depth = alike[same], depth + 1
    return out


def _starts(candidates: list[str], prefixes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First candidate with each prefix and first one after them, in the sorted list."""
    low = [bisect_left(candidates, p) for p in prefixes]
    high = [bisect_left(candidates, p + "Ā", lo) for p, lo in zip(prefixes, low, strict=True)]
    return np.array(low, np.int64), np.array(high, np.int64)


def scan(candidates: list[str], queries: list[str], halves: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs exactly one edit apart that share the query's first letters, `halves` of them.

    `candidates` are sorted and distinct.
    """
    if not candidates or not queries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    listed, asked = Words.of(candidates), Words.of(queries)
    lcps, half = adjacent_lcps(listed), np.array(halves, np.int64)
    low, high = _starts(candidates, [q[:h] for q, h in zip(queries, halves, strict=True)])
    # From the shared half on: query, range of candidates with the same prefix, three cells of the edit matrix's row.
    entering = {int(d): np.flatnonzero((half == d) & (low < high)) for d in np.unique(half)}
    alive = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int8)] * 3
    pairs_q, pairs_c = [], []
    depth, last = min(entering), max(entering)
    while depth <= last or len(alive[0]):
        if depth in entering:
            new = entering[depth]
            one = np.ones(len(new), np.int8)
            # The prefix is the query's own: no edit on the diagonal, one beside it.
            alive = [np.concatenate(x) for x in zip(alive, [new, low[new], high[new], one, one * 0, one], strict=True)]
        query, first, end, before, here, after = alive
        # A candidate that ends with the prefix comes first in its range.
        ended = listed.lengths[first] == depth
        gap = asked.lengths[query] - depth
        edits = np.select([gap == -1, gap == 0, gap == 1], [before, here, after], 2)
        found = ended & (edits == 1)
        pairs_q.append(query[found])
        pairs_c.append(first[found])
        # Ranges of the next depth begin where fewer letters are shared.
        begins = np.flatnonzero(lcps <= depth)
        at, upto = np.searchsorted(begins, first + ended), np.searchsorted(begins, end)
        counts = np.maximum(upto - at, 0)
        total = int(counts.sum())
        if not total:
            alive = [x[:0] for x in alive]
            depth += 1
            continue
        parent = np.repeat(np.arange(len(query)), counts)
        child = at[parent] + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        start = begins[child]
        stop = np.append(begins[1:], len(lcps))[child]
        query, before, here, after = query[parent], before[parent], here[parent], after[parent]
        letter = listed.letter(start, depth)
        differs = [(letter != asked.letter(query, depth + j)).astype(np.int8) for j in (-1, 0, 1)]
        left = np.minimum(before + differs[0], here + 1)
        mid = np.minimum(np.minimum(here + differs[1], after + 1), left + 1)
        right = np.minimum(after + differs[2], mid + 1)
        keep = np.minimum(np.minimum(left, mid), right) <= 1
        alive = [x[keep] for x in (query, start, np.minimum(stop, end[parent]), left, mid, right)]
        depth += 1
    return np.concatenate(pairs_q), np.concatenate(pairs_c)


def _within_one(prefix: str, word: str) -> bool:
    """Whether some beginning of `word` is at most one edit from `prefix`."""
    shared = len(commonprefix([prefix, word]))
    rest, tail = prefix[shared + 1 :], prefix[shared:]
    return word.startswith((rest, tail), shared + 1) or word.startswith(rest, shared)


def first_letters(word: str) -> int:
    """Letters of the half that a near word shares if its edit comes later."""
    return len(word) // 2


def _route(parts: list[tuple[int, str, str]], backward: bool):
    """Task function: the ranges every word has to scan, from the ranges' first and last words."""
    lasts = [last for _, _, last in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, targets = [], []
            for word in batch.column(0).to_pylist():
                half = first_letters(word)
                key = word[::-1] if backward else word
                prefix = key[: len(word) - half if backward else half][:SHOWN]
                # Last words are cut: one that begins like the prefix may come after it.
                at = bisect_left(lasts, prefix)
                while at < len(parts) and parts[at][1][: len(prefix)] <= prefix:
                    part, first, last = parts[at]
                    if _within_one(commonprefix([first, last]), key):
                        words.append(word)
                        targets.append(part)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(targets, pa.int32())], ["word", "part"])

    return run


def _near_in_range(backward: bool):
    """Group function: per word its near words in one range, counted, and the most frequent of them."""
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)

    def run(asking: pa.Table, listed: pa.Table) -> pa.Table:
        listed = listed.select(["word", "n"])
        names = [turn(w) for w in listed.column("word").to_pylist()]
        order = sorted(range(len(names)), key=names.__getitem__)
        candidates = [names[i] for i in order]
        counts = listed.column("n").to_numpy()[order]
        words = asking.column("word").to_pylist()
        out = []
        for at in range(0, len(words), SCAN_WORDS):
            own = words[at : at + SCAN_WORDS]
            keys, halves = [turn(w) for w in own], [first_letters(w) for w in own]
            q, c = scan(candidates, keys, [len(w) - h for w, h in zip(own, halves, strict=True)] if backward else halves)
            if backward:
                # Pairs that share the first half too were found in the forward list.
                fresh = [not candidates[j][::-1].startswith(own[i][: halves[i]]) for i, j in zip(q.tolist(), c.tolist(), strict=True)]
                fresh = np.array(fresh, bool)
                q, c = q[fresh], c[fresh]
            if not len(q):
                continue
            near = [turn(candidates[j]) for j in c.tolist()]
            best = sorted(range(len(q)), key=lambda i: (q[i], -counts[c[i]], near[i]))
            firsts = np.flatnonzero(np.diff(q[best], prepend=-1))
            chosen = np.array(best)[firsts]
            out.append(
                pa.table(
                    {
                        "word": pa.array([own[i] for i in q[chosen].tolist()], pa.string()),
                        "n_near": pa.array(np.diff(np.append(firsts, len(q))), pa.int64()),
                        "least": pa.array(-counts[c[chosen]], pa.int64()),
                        "best": pa.array([near[i] for i in chosen.tolist()], pa.string()),
                    }
                )
            )
        empty = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("least", pa.int64()), ("best", pa.string())])
        return pa.concat_tables(out) if out else empty.empty_table()

    return run


def _near_counts(words: DataFrame, size: int, backward: bool, range_words: int) -> DataFrame:
    """(word, n_near, least, best) parts from the vocabulary sorted forward or backward."""
    key = F.reverse("word") if backward else F.col("word")
    ranges = -(-size // range_words)
    placed = words.withColumn("_key", key).repartitionByRange(ranges, "_key").withColumn("part", F.spark_partition_id())
    label = "backward" if backward else "forward"
    placed = written(placed, f"{label}-words")
    shown = placed.groupBy("part").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"))
    # A row for every `range_words` words, of bounded length.
    parts = sorted((r.lo, r.part, r.hi) for r in shown.select("part", *(F.substring(c, 1, SHOWN).alias(c) for c in ("lo", "hi"))).collect())
    parts = [(part, lo, hi) for lo, part, hi in parts]
    asking = written(words.select("word").mapInArrow(_route(parts, backward), "word string, part int"), f"{label}-queries")
    # Ranges that many words ask are scanned by several groups.
    asked = asking.groupBy("part").agg(F.ceil(F.count("*") / (2 * range_words)).cast("int").alias("blocks"))
    asking = asking.join(F.broadcast(asked), "part").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    listed = placed.join(F.broadcast(asked), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = asking.groupBy("part", "block").cogroup(listed.select("word", "n", "part", "block").groupBy("part", "block"))
    return groups.applyInArrow(_near_in_range(backward), "word string, n_near bigint, least bigint, best string")


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of the words that have a form, by doubling the steps taken.

    A form is RATIO times as frequent, which bounds the length of a chain by the
    largest count.
    """
    steps, length = 1, 1
    while RATIO**length <= most:
        length += 1
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while steps < length:
        after = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = written(lookup_join(at, after, ["root"], "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
        steps *= 2
    return at


def variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    range_words: int = RANGE_WORDS,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. By the
    checksum of `<doc_id>:<run>` one run in ERRORS loses a letter; a row without
    id loses none. Null texts have no words, equal texts under one id count as often as
    they occur, and an empty table gives no row. Near words differ by exactly
    one inserted, deleted or replaced letter. `form` is the most frequent near
    word (ties: the smallest) if it occurs RATIO times as often, and `root` the
    last word that forms lead to. Runs may be of any length.
    """
    words = written(vocabulary(docs, doc_id, text, least_letters, least_count), "vocabulary")
    size, most = words.agg(F.count("*"), F.max("n")).first()
    if not size:
        return words.select("word", F.col("word").alias("form"), F.col("word").alias("root"), "n", F.col("n").alias("n_near"), F.col("n").alias("form_n"))
    near = _near_counts(words, size, False, range_words).unionByName(_near_counts(words, size, True, range_words))
    best = F.min(F.struct("least", "best"))
    near = written(near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")), "near")
    counted = words.join(near, "word", "left")
    chosen = -F.col("_best.least") >= F.lit(RATIO) * F.col("n")
    counted = counted.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, F.col("_best.best")).alias("form"),
        F.when(chosen, -F.col("_best.least")).alias("form_n"),
    )
    counted = written(counted, "forms")
    roots = _roots(counted.filter("form is not null"), most)
    return counted.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
