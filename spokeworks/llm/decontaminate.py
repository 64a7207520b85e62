"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every substring of the normalised benchmark items. Training
words are streamed through it; after each word the automaton's depth is the
length of the longest match that ends there. A match of `window` words or more,
or of a whole shorter item, marks its words as hit. Spans and shares of hit
words then decide what goes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from spokeworks.llm.tables import free_name, written
from spokeworks.llm.textbytes import ALNUM, lowered, text_slices, utf8_bytes, word_hashes, word_spans

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Item words that one automaton holds; more items make more automata.
BLOCK_WORDS = 200_000


@dataclass
class Automaton:
    """Suffix automaton over word numbers, with the windows that end at each state.

    `windows[state]` lists the items that have the window ending in that state:
    one of `window` words, or a whole item of fewer. `up[state]` is the nearest
    state on the suffix path, itself included, that ends a window.
    """

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    windows: dict[int, list[int]] = field(default_factory=dict)
    up: list[int] = field(default_factory=list)
    shortest: int = 0
    hashes: np.ndarray | None = None

    def _extend(self, last: int, word: int) -> int:
        """Append a word behind state `last`; the new last state."""
        step, link, depth = self.next, self.link, self.depth
        known = step[last].get(word)
        if known is not None and depth[known] == depth[last] + 1:
            return known
        if known is None:
            fresh = len(step)
            step.append({})
            depth.append(depth[last] + 1)
            link.append(0)
            at = last
            while at != -1 and word not in step[at]:
                step[at][word] = fresh
                at = link[at]
            if at == -1:
                return fresh
            target = step[at][word]
            if depth[target] == depth[at] + 1:
                link[fresh] = target
                return fresh
        else:
            fresh, at, target = -1, last, known
        copy = len(step)
        step.append(dict(step[target]))
        depth.append(depth[at] + 1)
        link.append(link[target])
        link[target] = copy
        while at != -1 and step[at].get(word) == target:
            step[at][word] = copy
            at = link[at]
        if fresh == -1:
            return copy
        link[fresh] = copy
        return fresh

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _climb(self, state: int, length: int) -> int:
        """The state that holds the suffix of `length` words of a match in `state`."""
        while self.depth[self.link[state]] >= length:
            state = self.link[state]
        return state

    def mark(self, item: int, words: list[int]) -> None:
        """Note the item's windows at the states where they end."""
        size = min(self.window, len(words))
        state = 0
        for i, word in enumerate(words):
            state = self.next[state][word]
            if i + 1 >= size:
                held = self.windows.setdefault(self._climb(state, size), [])
                if not held or held[-1] != item:
                    held.append(item)

    def close(self) -> None:
        """Fill `up`, shallow states first, as a suffix link always leads to a shallower one."""
        up = [-1] * len(self.depth)
        for state in np.argsort(self.depth, kind="stable").tolist():
            if state:
                up[state] = state if state in self.windows else up[self.link[state]]
        self.up = up

    def scan(self, words: list[int], hit: np.ndarray, at: int, states: set[int]) -> None:
        """Stream word numbers; set `hit` from position `at` on and note the window states met."""
        step, link, depth, up, window = self.next, self.link, self.depth, self.up, self.window
        state, length, begun, ended = 0, 0, 0, -1
        for end, word in enumerate(words, at + 1):
            while state and word not in step[state]:
                state = link[state]
                length = depth[state]
            if word in step[state]:
                state = step[state][word]
                length += 1
            longest, low = 0, up[state] if state else -1
            while low > 0:
                # A state may be deeper than the match; its window has at most `window` words.
                size = min(window, depth[low])
                if size <= length:
                    longest = max(longest, length if size == window else size)
                    states.add(low)
                low = up[link[low]] if link[low] > 0 else -1
            if longest:
                start = end - longest
                if ended == end - 1 and begun <= start:
                    hit[end - 1] = True
                else:
                    hit[start:end] = True
                    begun = start
                ended = end


def item_words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8").lower())


def build_automaton(items: list[tuple[int, str]], window: int) -> Automaton:
    """Automaton over (item number, text); items without words are left out."""
    automaton = Automaton(window)
    vocabulary = automaton.vocabulary
    numbered = []
    for number, text in items:
        words = [vocabulary.setdefault(w, len(vocabulary)) for w in item_words(text)]
        if words:
            numbered.append((number, words))
            automaton.add(words)
    for number, words in numbered:
        automaton.mark(number, words)
    automaton.close()
    automaton.shortest = min((min(window, len(w)) for _, w in numbered), default=0)
    if vocabulary:
        data, offsets = utf8_bytes(pa.array([w.decode("utf-8") for w in vocabulary], pa.string()))
        starts, lengths, _ = word_spans(data, offsets, ALNUM)
        automaton.hashes = np.sort(word_hashes(data, starts, lengths))
    return automaton


def _matches(automaton: Automaton, ids: list, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list]]:
    """For every row of (id, text): its number of words, hit positions, item ids."""
    raw, offsets = utf8_bytes(batch.column(1))
    data = lowered(raw)
    starts, lengths, counts = word_spans(data, offsets, ALNUM)
    runs: dict[int, list[tuple[int, int]]] = {}
    firsts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=firsts[1:])
    if automaton.shortest and len(starts):
        hashed = word_hashes(data, starts, lengths)
        near = np.minimum(np.searchsorted(automaton.hashes, hashed), len(automaton.hashes) - 1)
        known = np.zeros(len(starts) + 2, np.int8)
        known[1:-1] = automaton.hashes[near] == hashed
        # An unknown word takes the automaton back to its root, so each run of known
        # words is a stream of its own, and one shorter than any window has no hit.
        edges = np.diff(known)
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = ends - begins >= automaton.shortest
        begins, ends = begins[long], ends[long]
        rows = np.searchsorted(firsts, begins, side="right") - 1
        for begin, end, row in zip(begins.tolist(), ends.tolist(), rows.tolist()):
            while begin < end:  # a run may go on into the next rows
                stop = min(end, int(firsts[row + 1]))
                if stop - begin >= automaton.shortest:
                    runs.setdefault(row, []).append((begin, stop))
                begin, row = stop, row + 1
    text = data.tobytes() if runs else b""
    for row, n in enumerate(counts.tolist()):
        if row not in runs:
            yield n, np.zeros(0, np.int64), []
            continue
        hit = np.zeros(n, dtype=bool)
        states: set[int] = set()
        for begin, end in runs[row]:
            spans = zip(starts[begin:end].tolist(), lengths[begin:end].tolist())
            # Equal hashes of unequal words count as unknown.
            words = [automaton.vocabulary.get(text[s : s + size], -1) for s, size in spans]
            automaton.scan(words, hit, begin - int(firsts[row]), states)
        met = {ids[number] for state in states for number in automaton.windows[state]} - {None}
        yield n, np.flatnonzero(hit), sorted(met)


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list]:
    """Items in order of id, in blocks of at most `most` words each, one item at least."""
    items = benchmark.select(item_id, text).orderBy(item_id, text)
    block, held = [], 0
    for row in items.toLocalIterator():
        size = len(item_words(row[1]))
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += size
    yield block


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document row: id, n_words, hits (word positions), items (ids of items with a window in it).

    Null and empty texts have no words; items without words match nothing; an
    item without id marks words but is not listed; repeated rows give repeated
    results; other columns are not looked at. The benchmark is the stated query
    set: it is taken in blocks of bounded size, and only one block's automaton
    at a time is sent to the tasks of a pass. Documents are never shuffled
    unless there are several blocks, whose hits are then put together.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    item_type = benchmark.schema[item_id].dataType.simpleString()
    item_arrow = benchmark.select(item_id).limit(0).toArrow().schema.field(0).type
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    schema = f"_id {id_type.simpleString()}, n_words bigint, hits array<int>, items array<{item_type}>"

    def scan(block: list, source: DataFrame) -> DataFrame:
        automaton = build_automaton([(i, body) for i, (_, body) in enumerate(block)], window)
        sent = spark.sparkContext.broadcast((automaton, [name for name, _ in block]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, ids = sent.value
            for batch in batches:
                for part in text_slices(batch, 1):
                    found = list(_matches(held, ids, part))
                    columns = [
                        part.column(0),
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([h for _, h, _ in found], pa.list_(pa.int32())),
                        pa.array([i for _, _, i in found], pa.list_(item_arrow)),
                        *part.columns[2:],
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["_id", "n_words", "hits", "items", *part.schema.names[2:]])

        return source.mapInArrow(run, schema + ", _hash bigint" * (len(source.columns) > 2))

    blocks = _blocks(benchmark, item_id, item_text, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = scan(first, source)
    else:
        # The result depends on the text alone, so equal rows may be counted and put back.
        keyed = source.withColumn("_hash", F.xxhash64("_text", F.length("_text")))
        passes = [scan(block, keyed).withColumn("_block", F.lit(i)) for i, block in enumerate([first, second, *blocks])]
        merged = passes[0]
        for more in passes[1:]:
            merged = merged.unionByName(more)
        found = (
            merged.groupBy("_id", "_hash", "n_words")
            .agg(
                F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"),
                F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
                F.count(F.when(F.col("_block") == 0, 1)).cast("int").alias("_rows"),
            )
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_rows"))))
        )
    return found.select(F.col("_id").alias(doc_id), "n_words", F.sort_array("hits").alias("hits"), "items")


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    percent: int = 5,
    cut_longer_than: int | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of `docs` that are not contaminated, with the columns they have.

    A row is contaminated if it has a hit word and hit words make up at least
    `percent` of 100 of its words; each row is judged where it lies, whatever its
    id. With `cut_longer_than`, runs of more hit words than that are cut from the
    texts that stay. A benchmark of several blocks takes a pass for each, over
    rows that carry their hits along; nothing is shuffled.
    """
    spark = docs.sparkSession
    at, schema = docs.columns.index(text), docs.schema
    marked_schema = StructType([*schema.fields, StructField(free_name(docs, "hits"), ArrayType(IntegerType()))])

    def scan(block: list, last: bool):
        sent = spark.sparkContext.broadcast(build_automaton([(i, body) for i, (_, body) in enumerate(block)], window))
        names = [None] * len(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, at):
                    texts = pa.RecordBatch.from_arrays([part.column(at), part.column(at)], ["id", "text"])
                    found = list(_matches(sent.value, names, texts))
                    hits = [h for _, h, _ in found]
                    if part.num_columns > len(schema):
                        before = part.column(len(schema)).to_pylist()
                        hits = [np.union1d(h, np.array(b or [], np.int64)).astype(np.int64) for h, b in zip(hits, before, strict=True)]
                    rows = part.select(range(len(schema)))
                    if not last:
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(hits, pa.list_(pa.int32()))], marked_schema.names)
                        continue
                    if cut_longer_than is not None:
                        bodies = [remove_spans(t.as_py(), h, cut_longer_than) for t, h in zip(rows.column(at), hits, strict=True)]
                        rows = rows.set_column(at, rows.schema.field(at), pa.array(bodies, rows.schema.field(at).type))
                    clean = [not len(h) or 100 * len(h) < percent * n for (n, _, _), h in zip(found, hits, strict=True)]
                    yield rows.filter(pa.array(clean, pa.bool_()))

        return run

    blocks = _blocks(benchmark, item_id, item_text, block_words)
    block, rows = next(blocks), docs
    for following in blocks:
        rows = written(rows.mapInArrow(scan(block, False), marked_schema), "marked")
        block = following
    return rows.mapInArrow(scan(block, True), schema)


def contamination_report(matches: DataFrame, doc_id: str = "doc_id", percent: int = 5) -> DataFrame:
    """One row per row of `find_matches`: counts, digest of the items, and the verdict.

    A document is contaminated if it has a hit word and hit words make up at
    least `percent` of 100 of its words. `longest_span` is the longest run of hit words.
    """
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    # A run's words all have the same position minus rank.
    ranks = F.transform("hits", lambda x, i: x - i)
    begins = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda i: (i == 0) | (F.get("_ranks", i) != F.get("_ranks", i - 1)))
    ends = F.concat(F.slice("_begins", 2, F.size("hits")), F.array(F.size("hits")))
    spans = F.zip_with("_begins", ends, lambda a, b: b - a)
    n_hit = F.size("hits").cast("bigint")
    return (
        matches.withColumn("_ranks", ranks)
        .withColumn("_begins", F.when(F.size("hits") > 0, begins).otherwise(F.array().cast("array<int>")))
        .select(
            F.col(doc_id),
            "n_words",
            n_hit.alias("n_hit"),
            F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
            ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
            F.coalesce(F.when(n_hit > 0, F.array_max(spans)), F.lit(0)).cast("bigint").alias("longest_span"),
        )
    )


def remove_spans(text: str | None, hits: list[int], longest: int) -> str | None:
    """The text without its runs of more than `longest` hit words; other characters stay."""
    if not text or not len(hits):
        return text
    data = text.encode("utf-8")
    spans = [m.span() for m in WORD.finditer(data.lower())]
    breaks = np.flatnonzero(np.diff(hits) > 1) + 1
    kept, at = [], 0
    for run in np.split(np.asarray(hits), breaks):
        if len(run) > longest:
            kept.append(data[at : spans[run[0]][0]])
            at = spans[run[-1]][1]
    kept.append(data[at:])
    return b"".join(kept).decode("utf-8")


def cut_spans(matched: DataFrame, text: str = "text", longest: int = 12) -> DataFrame:
    """Rows of documents that carry `hits` (see `find_matches`), with long hit spans cut from the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            hits = batch.column(batch.schema.get_field_index("hits"))
            bodies = [remove_spans(t.as_py(), h.as_py() or [], longest) for t, h in zip(batch.column(at), hits)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(bodies, pa.string()))

    return matched.mapInArrow(cut, matched.schema)
