"""Packing token sequences into fixed windows by non-negative least squares.

Documents are cut into whole windows and a remainder. The histogram of
remainders, by length class, is to be met by repeating combinations of up to
three classes that fill a window exactly: how often each is repeated is the
non-negative least-squares solution, rounded down to what there is. What is
left over is packed greedily, largest first. All of this works on the
histogram, whose size is fixed; the pieces themselves stay distributed and
find their sequence from their rank within their class.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spokeworks.llm.tables import written
from spokeworks.operators.ordinal import number_rows

WINDOW = 2048
# Lengths that differ by less share a class.
GRAIN = 8
END_ID = 1

Plan = list[tuple[dict[int, int], int]]


def load_encoder(path: str) -> Callable[[str], list[int]]:
    """Token ids of a text from a vocabulary file, without added ids.

    A `.json` file is read by tokenizers. A `.tiktoken` file holds the same
    byte-level vocabulary as ranks and gives the same ids several times faster;
    the id after the last rank is the end-of-text mark, which both recognise.
    Its pattern gives up on very long blank runs: such texts go to the `.json`
    file beside it.
    """
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        special = {"<|endoftext|>": len(ranks)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        whole: list[Callable[[str], list[int]]] = []

        def encode(text: str) -> list[int]:
            try:
                return own.encode(text, allowed_special="all")
            except ValueError:
                if not whole:
                    whole.append(load_encoder(path.removesuffix(".tiktoken") + ".json"))
                return whole[0](text)

        return encode
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def combinations(classes: int) -> list[dict[int, int]]:
    """Multisets of one to three classes that sum to `classes`."""
    out = [{classes: 1}]
    for a in range(1, classes // 2 + 1):
        out.append({a: 2} if 2 * a == classes else {a: 1, classes - a: 1})
    for a in range(1, classes // 3 + 1):
        for b in range(a, (classes - a) // 2 + 1):
            parts: dict[int, int] = {}
            for c in (a, b, classes - a - b):
                parts[c] = parts.get(c, 0) + 1
            out.append(parts)
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets."""
    x = np.zeros(a.shape[1])
    free: list[int] = []
    residual = b.copy()
    tolerance = 1e-9 * max(float(np.abs(a.T @ b).max(initial=0)), 1e-300)
    for _ in range(rounds):
        gain = a.T @ residual
        gain[free] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        free.append(best)
        while True:
            own = a[:, free]
            # Free columns are independent; the ridge only guards against rounding.
            solved = np.linalg.solve(own.T @ own + 1e-10 * np.eye(len(free)), own.T @ b)
            if (solved > 0).all():
                break
            now = x[free]
            falling = solved <= 0
            step = float((now[falling] / np.maximum(now[falling] - solved[falling], 1e-300)).min())
            now = now + step * (solved - now)
            keep = now > 1e-12
            x[:] = 0
            free = [f for f, k in zip(free, keep) if k]
            x[free] = now[keep]
            if not free:
                solved = np.zeros(0)
                break
        x[:] = 0
        x[free] = solved
        residual = b - a[:, free] @ x[free]
    return x


def plan_windows(histogram: np.ndarray) -> Plan:
    """Combinations of classes and how often each is used; index 0 of the histogram is unused.

    Every piece is placed: the sum over the plan equals the histogram.
    """
    top = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    plan: Plan = []

    def use(parts: dict[int, int], most: int) -> None:
        times = min(most, *(int(left[c]) // m for c, m in parts.items()))
        if times > 0:
            plan.append((parts, times))
            for c, m in parts.items():
                left[c] -= m * times

    use({top: 1}, int(left[top]))  # whole windows
    shapes = combinations(top)[1:]
    if left.sum():
        a = np.zeros((top, len(shapes)))
        for i, parts in enumerate(shapes):
            for c, m in parts.items():
                a[c - 1, i] = m
        x = non_negative_least_squares(a, left[1:] / left.sum()) * left.sum()
        for i in np.argsort(-x, kind="stable").tolist():
            if x[i] >= 0.5:
                use(shapes[i], int(round(x[i])))
    while left.any():
        parts, room = {}, top
        while room:
            fitting = np.flatnonzero(left[: room + 1] - np.array([parts.get(c, 0) for c in range(room + 1)]) > 0)
            if not len(fitting):
                break
            c = int(fitting[-1])
            m = min(int(left[c]) - parts.get(c, 0), room // c)
            parts[c] = parts.get(c, 0) + m
            room -= m * c
        use(parts, int(left.max()))
    return plan


def _places(plan: Plan, top: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first ranks, pieces per sequence, and first sequence ids of the plan's entries."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken, sequence = np.zeros(top + 1, np.int64), 0
    for parts, times in plan:
        for c, m in parts.items():
            rows.setdefault(c, []).append((int(taken[c]), m, sequence))
            taken[c] += m * times
        sequence += times
    return {c: tuple(np.array(v, np.int64) for v in zip(*entries)) for c, entries in rows.items()}


def cut_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, window: int = WINDOW) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) for every piece of every row.

    Tokens are the text's ids and then the end id; null is the empty text, so
    every row has a token. Pieces are whole windows from the start and the rest.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(path)
        for batch in batches:
            rows, starts, sizes, sums, totals, kept = [], [], [], [], [], []
            for i, body in enumerate(batch.column(1)):
                ids = np.array([*encode(body.as_py() or ""), END_ID], "<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    data = piece.tobytes()
                    rows.append(i)
                    starts.append(at)
                    sizes.append(len(piece))
                    sums.append(zlib.crc32(data))
                    totals.append(len(ids))
                    if with_ids:
                        kept.append(piece)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums, totals))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array([k.astype(np.int64) for k in kept], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<bigint>" * with_ids
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    window: int = WINDOW,
    buckets: int | None = None,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) for every piece.

    Each token lies in exactly one piece, each piece in one sequence of at most
    `window` tokens, gapless from offset 0. Pieces that agree in id, start and
    content are interchangeable. Other columns are not looked at; an empty
    table has no pieces.
    """
    top = window // GRAIN
    pieces = written(cut_pieces(docs, path, doc_id, text, with_ids, window).withColumn("copy", F.monotonically_increasing_id()), "pieces")
    kinds = pieces.withColumn("cls", F.ceil(F.col("length") / GRAIN).cast("int"))
    counts = kinds.groupBy("cls").agg(F.count("*").alias("total"))
    histogram = np.zeros(top + 1, np.int64)
    for row in counts.collect():  # one row for each class at most
        histogram[row["cls"]] = row["total"]
    places = _places(plan_windows(histogram), top)

    # Equal pieces differ in the number they were written under, so no order is too even to be cut.
    hashed = kinds.withColumn("h", F.xxhash64(F.lit(7), "id", "start", "ids_crc32", "length"))
    ranked = number_rows(hashed, ["h", "id", "start", "ids_crc32", "copy"], ["cls"], "rank", buckets=buckets).drop("h", "copy")
    ranked = ranked.withColumn("rank", F.col("rank") - 1)
    names = ranked.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id bigint, turn bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = batch.column(names.index("cls")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            sequence, turn = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls).tolist():
                own = cls == c
                firsts, each, base = places[c]
                entry = np.searchsorted(firsts, rank[own], side="right") - 1
                inside = rank[own] - firsts[entry]
                sequence[own] = base[entry] + inside // each[entry]
                turn[own] = c * (top + 1) + inside % each[entry]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(turn)], [*names, "sequence_id", "turn"])

    placed = ranked.mapInArrow(run, schema)
    # A sequence has as many pieces as tokens at most.
    before = Window.partitionBy("sequence_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        F.col("id").alias(doc_id),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
        *(["ids"] if with_ids else []),
    )
