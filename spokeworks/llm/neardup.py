"""Near-duplicate classes by SetSketch registers, banding, a likelihood estimate and exact checks.

A text's set is its distinct n-word shingles. Each register keeps the exponent,
in powers of a base just above 1, of the smallest of the set's exponential
variates, truncated to 16 bits: unions merge by taking the larger register, and
two sets agree in a register about as often as they share elements. Bands of
registers find candidates, the joint maximum-likelihood estimate of the
similarity discards most of the rest, and the full sets decide.

Equal sets are one node from the start. A bucket of a band never emits its
pairs: its members are first compared with one pivot, and members still apart
from each other are then compared exactly inside tasks. A large bucket of texts
that are alike, but not alike enough, is first dealt into smaller ones by their rarest
shingles: two sets that are similar share one of the first shingles of
either, in the order of how many members have them. What is still large is cut into
blocks of bounded size. Tasks return a spanning set of the links found. So no
link that the bands reach is lost, and rows stay in proportion to memberships.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.components import component_labels
from spokeworks.llm.tables import written
from spokeworks.llm.textbytes import SOLID, gram_hashes, lowered, text_slices, utf8_bytes, word_hashes, word_spans
from spokeworks.operators.joins import lookup_join

BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 2
REGISTERS = 256
# Chance that a pair exactly at the threshold shares no band, and that its registers rule it out.
MISS, RULED_OUT = 1e-6, 1e-8

# Ids that may be sent to all tasks instead of being joined: 8 MB.
BROADCAST_IDS = 1_000_000
# Members of a bucket, and bytes of their sets, that one task compares with as many others.
BLOCK = 1024
BLOCK_BYTES = 16 << 20

_MULTIPLIERS = np.random.default_rng(85).integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) with the most rows that miss a pair at the threshold with a chance of MISS at most."""
    share = percent / 100
    for rows in range(REGISTERS, 0, -1):
        apart = 1 - share**rows
        bands = max(math.ceil(math.log(MISS) / math.log(apart)), 1) if 0 < apart < 1 else 1
        if apart < 1 and bands * rows <= REGISTERS:
            return bands, rows
    raise ValueError(f"{REGISTERS} registers cannot find pairs of {percent} % with a miss of {MISS}")


def least_estimate(percent: int) -> float:
    """Share of equal registers below which a pair at the threshold comes with a chance of RULED_OUT at most."""
    share, below = percent / 100, 0.0
    for k in range(REGISTERS + 1):
        below += math.comb(REGISTERS, k) * share**k * (1 - share) ** (REGISTERS - k)
        if below > RULED_OUT:
            return k / REGISTERS
    return 1.0


def shingle_sets(texts: pa.Array, n: int = 3) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; fewer than n words are one shingle."""
    raw, offsets = utf8_bytes(texts)
    data = lowered(raw)
    starts, lengths, counts = word_spans(data, offsets, SOLID)
    words = word_hashes(data, starts, lengths)
    sets, at = [], 0
    for count in counts.tolist():
        own = words[at : at + count]
        at += count
        sets.append(np.unique(gram_hashes(own, min(n, count) if count else n)))
    return sets


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    short = (elements >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512, None] * _MULTIPLIERS).min(axis=0), out=least)
    # The smallest uniform value gives the smallest exponential variate of this rate.
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def estimate_similarity(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Jaccard similarity that makes the registers' order most likely, for rows of register pairs.

    `left` and `right` are (pairs, registers); the set sizes are known. The
    likelihood of larger, smaller and equal registers is maximised on a grid
    refined twice; it has one maximum.
    """
    above = (left > right).sum(axis=1)[:, None]
    below = (left < right).sum(axis=1)[:, None]
    equal = left.shape[1] - above - below
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    most = np.minimum(u, v) / np.maximum(u, v)
    low, high = np.zeros_like(u), most
    steps = np.linspace(0, 1, 17)[None, :]

    def share(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    best = low
    for _ in range(3):
        grid = low + (high - low) * steps
        p_above, p_below = share(u - v * grid), share(v - u * grid)
        parts = [(above, p_above), (below, p_below), (equal, 1 - p_above - p_below)]
        score = sum(np.where(k > 0, k * np.log(np.maximum(p, 1e-300)), 0) for k, p in parts)
        at = score.argmax(axis=1)[:, None]
        best = np.take_along_axis(grid, at, 1)
        width = (high - low) / 16
        low, high = np.maximum(best - width, 0), np.minimum(best + width, most)
    return best[:, 0]


def sketch(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(id, n, digest, regs, bands) for each row; a text without words has n 0 and no digest."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    cut = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                sets = shingle_sets(part.column(1), shingle)
                regs = [registers(s) if len(s) else None for s in sets]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                bands = [None if r is None else band_keys(r, *cut) for r in regs]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([None if r is None else r.tobytes() for r in regs], pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["id", "n", "digest", "regs", "bands"],
                )

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {id_type}, n bigint, digest binary, regs binary, bands array<bigint>"
    )


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = regs[: bands * rows].astype(np.uint64).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = gram_hashes(np.stack([out, cut[:, k]], 1).ravel(), 2)[::2]
    return out.view(np.int64)


def _only(df: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """Rows of `df` whose `column` is among the distinct `ids`, of which there are n."""
    ids = ids.withColumnRenamed(ids.columns[0], column)
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, column, "left_semi")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify_pairs(percent: int):
    """Keep (a, b) whose estimate is near enough and whose sets are similar."""
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            sides = [np.frombuffer(b"".join(col[k].to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("a_regs", "b_regs")]
            sizes = [col[k].to_numpy().astype(np.float64) for k in ("a_n", "b_n")]
            near = estimate_similarity(*sides, *sizes) >= least
            keep = [
                bool(near[i]) and _linked(np.frombuffer(col["a_set"][i].as_py(), np.uint64), np.frombuffer(col["b_set"][i].as_py(), np.uint64), percent)
                for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _spanning_links(percent: int):
    """Links between members of two blocks of a bucket, at most one fewer than members."""
    least = least_estimate(percent)

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids = table.column("id").to_pylist()
        labels = table.column("label").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.float64)
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        root = {label: label for label in labels}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        left = np.flatnonzero(side <= 1)
        right = np.flatnonzero(side >= 1) if (side == 1).any() else np.flatnonzero(side == 2)
        out_a, out_b = [], []
        for i in left.tolist():
            ratio = np.minimum(sizes[right], sizes[i]) / np.maximum(sizes[right], sizes[i])
            mine = find(labels[i])
            others = [j for j in right[100 * ratio >= percent].tolist() if find(labels[j]) != mine]
            if not others:
                continue
            rows = np.array(others)
            mirrored = np.broadcast_to(regs[i], (len(rows), REGISTERS))
            # Cheap first look: share of equal registers is close to the similarity.
            rows = rows[(regs[rows] == mirrored).mean(axis=1) >= least]
            if not len(rows):
                continue
            near = estimate_similarity(regs[rows], np.broadcast_to(regs[i], (len(rows), REGISTERS)), sizes[rows], np.full(len(rows), sizes[i]))
            for j in rows[near >= least].tolist():
                if find(labels[j]) != find(labels[i]) and _linked(sets[i], sets[j], percent):
                    root[find(labels[j])] = find(labels[i])
                    out_a.append(ids[i])
                    out_b.append(ids[j])
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array(out_a, kind), "b": pa.array(out_b, kind)})

    return run


def _sets_of(docs: DataFrame, doc_id: str, text: str, shingle: int, ids: DataFrame, sketches: DataFrame) -> DataFrame:
    """(id, n, regs, set) of the wanted documents, from their texts, written down."""
    n = ids.count()
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                sets = shingle_sets(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["id", "n", "regs", "set"],
                )

    wanted = _only(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id", ids, n)
    return written(wanted.mapInArrow(run, f"id {id_type}, n bigint, regs binary, set binary"), "sets")


def _open_buckets(members: DataFrame) -> DataFrame:
    """(key, size, bytes) of the buckets whose members lie in several components; buckets of the same members are one."""
    found = (
        members.groupBy("key")
        .agg(
            F.min("label").alias("lo"),
            F.max("label").alias("hi"),
            F.count("*").alias("size"),
            F.sum(8 * F.col("n")).alias("bytes"),
            F.bit_xor(F.xxhash64("rep")).alias("sum"),
        )
        .filter("lo <> hi")
    )
    return found.groupBy("size", "bytes", "sum").agg(F.min("key").alias("key")).select("key", "size", "bytes")


def _blocks() -> Column:
    return F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES, F.lit(1.0))).cast("int")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, shingle) of every shingle of every set."""
    for batch in batches:
        for at in range(batch.num_rows):
            own = np.frombuffer(batch.column(2)[at].as_py(), np.int64)
            repeated = batch.slice(at, 1).select([0, 1]).take(pa.array(np.zeros(len(own), np.int64)))
            yield pa.RecordBatch.from_arrays([*repeated.columns, pa.array(own)], ["id", "n", "shingle"])


def rare_shingle_buckets(sets: DataFrame, percent: int) -> DataFrame:
    """(key, id): the first shingles of each set, rarest first, of which two similar sets share one.

    A set of n that shares k or more with another, k being `percent` of n
    rounded up, has one of those among its first n - k + 1. Shingles of one
    set alone come first and lead to no other, so they need no row.
    """
    id_type = sets.schema["id"].dataType.simpleString()
    rows = sets.select("id", "n", "set").mapInArrow(_shingle_rows, f"id {id_type}, n bigint, shingle bigint")
    rows = written(rows, "shingles")
    common = rows.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1")
    shared = lookup_join(rows, common, ["shingle"], "inner")
    listed = shared.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("rare"))
    least = F.ceil(F.lit(percent) * F.col("n") / 100).cast("int")
    first = F.slice("rare", 1, F.greatest(F.size("rare") - least + 1, F.lit(0)))
    return listed.select("id", F.explode(first).alias("one")).select("id", F.col("one.shingle").alias("key"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row; ids are distinct.

    Words are runs of characters other than ASCII white space, with A-Z
    lower-cased. Texts are linked if 100 * shared >= percent * all shingles. A
    component's id is its smallest document id. Null, empty and blank texts have
    no shingles, are linked with nothing and stay. A null id is its own
    component and stays. Rows that repeat an id with the same text count once
    as a node, and all of them are returned. Extra columns are not looked at. A link at
    the threshold is missed with a chance of MISS + 2 * RULED_OUT at most by the
    model of independent registers; a `percent` that 256 registers cannot serve so
    is refused.
    """
    sketches = written(sketch(docs, doc_id, text, shingle, percent), "sketches")
    full = sketches.filter("n > 0 and id is not null")
    # Equal sets are one node, named by the smallest id.
    nodes = full.groupBy("digest", "n").agg(F.min_by(F.struct("regs", "bands"), "id").alias("s"), F.min("id").alias("rep"))
    bands = nodes.select("rep", "n", F.explode("s.bands").alias("key"))
    # The pivot is the same random choice in every band, so that bands find the same pairs.
    turn = F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("pivot"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("size"), F.min(turn)["pivot"].alias("pivot")).filter("size > 1")
    members = written(lookup_join(bands, buckets, ["key"], "inner").select("key", "rep", "n", "pivot"), "members")
    sets = _sets_of(docs, doc_id, text, shingle, members.select(F.col("rep").alias("id")).distinct(), sketches)
    if not full.groupBy("id").count().filter("count > 1").isEmpty():
        sets = sets.dropDuplicates(["id"])

    pairs = members.filter("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    named = lambda side: sets.select(*(F.col(c).alias(f"{side}_{c}" if c != "id" else side) for c in sets.columns))
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    id_type = docs.schema[doc_id].dataType.simpleString()
    links = written(both.mapInArrow(_verify_pairs(percent), f"a {id_type}, b {id_type}"), "links")
    labels = component_labels(links, "a", "b")

    # Members that are not the pivot and lie in several components have not been compared.
    rest = members.filter("rep <> pivot").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    rest = rest.withColumn("label", F.coalesce("label", "rep"))
    rest = written(rest.select("key", "rep", "n", "label"), "open-members")
    buckets = _open_buckets(rest).withColumn("blocks", _blocks())
    buckets = written(buckets, "open-buckets")
    small = lookup_join(rest, buckets.filter("blocks = 1"), ["key"], "inner").select("key", "rep", "n", "label")
    large = lookup_join(rest, buckets.filter("blocks > 1"), ["key"], "inner").select(F.col("rep").alias("id"), "label").distinct()
    large = written(large, "large-members")
    if not large.isEmpty():
        many = sets.join(large.select("id"), "id", "left_semi")
        rare = rare_shingle_buckets(many, percent).join(large, "id").join(many.select("id", "n"), "id")
        small = small.unionByName(rare.select("key", F.col("id").alias("rep"), "n", "label"))
    small = written(small, "small-buckets")
    final = _open_buckets(small).withColumn("blocks", _blocks()).select("key", "blocks")
    spread = lookup_join(small, final, ["key"], "inner")
    spread = spread.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.col("rep").alias("id"),
        "label",
        F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2).alias("side"),
    )
    tasks = spread.join(sets, "id")
    more = written(tasks.groupBy("key", "i", "j").applyInArrow(_spanning_links(percent), f"a {id_type}, b {id_type}"), "more-links")
    if not more.isEmpty():
        labels = component_labels(links.unionByName(more), "a", "b")

    classes = nodes.select("digest", "n", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("digest", "n", F.coalesce("label", "rep").alias("component"))
    own = F.coalesce("component", "id")
    # Equal sets may be many: a join that can split them.
    return lookup_join(sketches.select("id", "n", "digest"), classes, ["digest", "n"], "left").select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"),
    )
