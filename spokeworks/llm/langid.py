"""Language identification by character models with interpolated Kneser-Ney smoothing.

Every language has a model of the next character after three others. N-grams are
kept as sorted arrays of 64-bit hashes, one array per length for all languages,
beside their log-probabilities in each. A text goes to the language with the
lowest cross-entropy per character. A calibration set of snippets, left out of
the counts, gives the scale of the score and the cross-entropy beyond which the
answer is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.tables import held_out, written
from spokeworks.llm.textbytes import mix64, text_slices
from spokeworks.operators.joins import lookup_join

ORDER = 4
DISCOUNT = 0.75
# Documents of each language that are counted, in the mean; the choice goes by hash.
SAMPLE_DOCS = 1_200
# Bytes that all models together may have and still be sent to every task.
MOST_MODEL_BYTES = 512 << 20
_SPACE = 32

_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def normalised(text: str) -> np.ndarray:
    """UTF-16 units of the lower-cased text, every run of other than letters one space, three before.

    A letter beyond U+FFFF keeps both its units.
    """
    units = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), "<u2")
    letter = _LETTER[units]
    pair = np.flatnonzero((units[:-1] & 0xFC00 == 0xD800) & (units[1:] & 0xFC00 == 0xDC00))
    code = 0x10000 + ((units[pair].astype(np.int64) & 0x3FF) << 10) + (units[pair + 1] & 0x3FF)
    pair = pair[_LETTER[code]]
    letter[pair] = letter[pair + 1] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    inner = np.where(letter, units, _SPACE)[keep]
    return np.concatenate([np.full(ORDER - 1, _SPACE, "<u2"), inner]).astype(np.uint64)


def gram_keys(units: np.ndarray, n: int) -> np.ndarray:
    """Packed n-grams that end at each position from the third on."""
    keys = np.zeros(max(len(units) - ORDER + 1, 0), np.uint64)
    for k in range(n):
        first = ORDER - n + k
        keys = (keys << np.uint64(16)) | units[first : first + len(keys)]
    return keys


def _ngram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, 1):
            langs = part.column(0).to_pylist()
            for lang in sorted(set(langs)):
                own = [gram_keys(normalised(t or ""), ORDER) for t, x in zip(part.column(1).to_pylist(), langs) if x == lang]
                keys, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "key", "n"],
                )


def _look_up(keys: np.ndarray, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each packed n-gram in a sorted hash array, and whether it is there."""
    hashes = mix64(keys)
    if not len(sorted_hashes):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == hashes


@dataclass
class Model:
    """For n-grams of each length 1 to 4: sorted hashes, log-probabilities and back-off weights by language."""

    langs: list[str]
    hashes: list[np.ndarray] = field(default_factory=list)
    log_p: list[np.ndarray] = field(default_factory=list)
    log_back: list[np.ndarray] = field(default_factory=list)
    log_floor: float = -11.0
    log_root: np.ndarray | None = None
    scale: float = 0.05
    limits: np.ndarray | None = None
    common: int = 0

    def size(self) -> int:
        return sum(x.nbytes for group in (self.hashes, self.log_p, self.log_back) for x in group)

    def _log_probabilities(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Log-probability of each n-gram's last character after the others, by language."""
        if n == 0:
            return np.full((len(keys), len(self.langs)), self.log_floor, np.float32)
        at, known = _look_up(keys, self.hashes[n - 1])
        out = self.log_p[n - 1][at] if len(self.hashes[n - 1]) else np.zeros((len(keys), len(self.langs)), np.float32)
        missing = np.flatnonzero(~known)
        if len(missing):
            lost = keys[missing]
            shorter = self._log_probabilities(lost & np.uint64((1 << (16 * (n - 1))) - 1), n - 1)
            if n > 1:
                place, seen = _look_up(lost >> np.uint64(16), self.hashes[n - 2])
                shorter += np.where(seen[:, None], self.log_back[n - 2][place], 0) if len(self.hashes[n - 2]) else 0
            else:
                shorter += self.log_root
            out[missing] = shorter
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character by text and language, and the characters counted."""
        units = [normalised(t) for t in texts]
        sizes = np.array([max(len(u) - ORDER + 1, 0) for u in units])
        sums = np.zeros((len(texts), len(self.langs)))
        if sizes.sum():
            logs = self._log_probabilities(np.concatenate([gram_keys(u, ORDER) for u in units]), ORDER)
            full = np.flatnonzero(sizes)
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            sums[full] = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
        return -sums / np.maximum(sizes, 1)[:, None], sizes


def build_model(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Model from each language's packed 4-grams (sorted) and their counts."""
    model = Model(langs)
    grams = {lang: {ORDER: counts[lang]} for lang in langs}
    for lang in langs:
        for n in range(ORDER - 1, 0, -1):
            # Lower orders count the different characters seen before, as Kneser and Ney do.
            keys = grams[lang][n + 1][0]
            grams[lang][n] = np.unique(keys & np.uint64((1 << (16 * n)) - 1), return_counts=True)
    alphabet = np.unique(np.concatenate([grams[x][1][0] for x in langs])) if langs else np.zeros(0, np.uint64)
    model.log_floor = float(-np.log(len(alphabet) + 1))
    model.log_root = np.array([np.log(DISCOUNT * len(k) / c.sum()) for k, c in (grams[x][1] for x in langs)])
    for n in range(1, ORDER + 1):
        own = [grams[x][n][0] for x in langs]
        if n < ORDER:  # contexts need a place too
            own += [grams[x][n + 1][0] >> np.uint64(16) for x in langs]
        union = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        shorter = model._log_probabilities(union & np.uint64((1 << (16 * (n - 1))) - 1), n - 1)
        log_p = np.zeros((len(union), len(langs)), np.float32)
        for i, lang in enumerate(langs):
            keys, c = grams[lang][n]
            seen = np.zeros(len(union))
            seen[np.searchsorted(union, keys)] = c
            contexts, inverse = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(inverse, c)
            kinds = np.bincount(inverse)
            at = np.minimum(np.searchsorted(contexts, union >> np.uint64(16)), max(len(contexts) - 1, 0))
            known = contexts[at] == union >> np.uint64(16) if len(contexts) else np.zeros(len(union), bool)
            weight = np.where(known, DISCOUNT * kinds[at] / total[at], 1.0)
            direct = np.where(known, np.maximum(seen - DISCOUNT, 0) / total[at], 0.0)
            log_p[:, i] = np.log(direct + weight * np.exp(shorter[:, i]))
        order = np.argsort(mix64(union), kind="stable")
        model.hashes.append(mix64(union)[order])
        model.log_p.append(log_p[order])
        # What a context leaves to shorter ones, for the n-grams of the next order.
        back = np.zeros((len(union), len(langs)), np.float32)
        if n < ORDER:
            for i, lang in enumerate(langs):
                keys, c = grams[lang][n + 1]
                contexts, inverse = np.unique(keys >> np.uint64(16), return_inverse=True)
                back[np.searchsorted(union, contexts), i] = np.log(DISCOUNT * np.bincount(inverse) / np.bincount(inverse, c))
        model.log_back.append(back[order])
    return model


def _snippets(text: str, index: int) -> list[str]:
    """Short pieces of a text, from all over it."""
    step = max(len(text) // 4, 1)
    return [text[at : at + (20, 40, 80, 160)[(index + k) % 4]] for k, at in enumerate(range(0, len(text), step))][:4]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Models of every language among documents outside the held-out fifth.

    A language's documents are chosen by hash, `sample_docs` in the mean, one
    at least; a fifth of them, if there are several, calibrates. Rows without
    id, text or language teach nothing.
    """
    spark = docs.sparkSession
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    h = F.xxhash64(F.lit(5), F.col(doc_id))
    light = known.select(F.col(lang).alias("lang"), h.alias("h"))
    shares = written(light.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("first")), "languages")
    rows = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h"))
    joined = rows.join(F.broadcast(shares), "lang") if shares.count() <= 1_000 else lookup_join(rows, shares, ["lang"], "inner")
    spot = F.col("h").cast("double") / 2.0**64 + 0.5
    sample = joined.filter((spot * F.col("n") < sample_docs) | (F.col("h") == F.col("first")))
    aside = (F.pmod(F.col("h"), F.lit(5)) == 0) & (F.col("h") != F.col("first"))

    counted = sample.filter(~aside).select("lang", "text").mapInArrow(_ngram_counts, "lang string, key bigint, n bigint")
    table = counted.groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    names = np.array(table.column("lang").to_pylist(), dtype=object)
    keys, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    counts = {}
    for x in langs:
        own = names == x
        order = np.argsort(keys[own])
        counts[x] = (keys[own][order], n[own][order])
    model = build_model(langs, counts)
    if model.size() > MOST_MODEL_BYTES:
        raise ValueError(f"models of {model.size()} bytes are too many to send; lower sample_docs")
    totals = {row["lang"]: row["n"] for row in shares.filter(F.col("lang").isin(langs)).collect()} if langs else {}
    model.common = int(np.argmax([totals[x] for x in langs])) if langs else 0
    model.limits = np.full(len(langs), np.inf)
    sent = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [(x, s) for x, t, i in zip(*(batch.column(k).to_pylist() for k in range(3))) for s in _snippets(t, i % 4)]
            ce, sizes = sent.value.cross_entropies([s for _, s in pieces])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in pieces], pa.string()), pa.array(list(ce), pa.list_(pa.float64())), pa.array(sizes, pa.int64())],
                ["lang", "ce", "size"],
            )

    found = sample.filter(aside).select("lang", "text", "h").mapInArrow(measure, "lang string, ce array<double>, size bigint").toArrow() if langs else None
    if found is not None and found.num_rows:
        ce = np.array(found.column("ce").to_pylist())
        sizes = found.column("size").to_numpy()
        truth = np.array([langs.index(x) if x in totals else -1 for x in found.column("lang").to_pylist()])
        use = (sizes > 0) & (truth >= 0)
        _calibrate(model, ce[use], sizes[use], truth[use])
    return model


def _log_posterior(model: Model, ce: np.ndarray, sizes: np.ndarray, scale: float) -> np.ndarray:
    raw = -ce * scale * sizes[:, None]
    raw = raw - raw.max(axis=1, keepdims=True)
    return raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))


def _calibrate(model: Model, ce: np.ndarray, sizes: np.ndarray, truth: np.ndarray) -> None:
    """Scale with the likeliest snippets, and for each language the cross-entropy that 99.5 % stay under."""
    if not len(truth):
        return
    scales = np.geomspace(0.005, 2, 40)
    losses = [-_log_posterior(model, ce, sizes, s)[np.arange(len(truth)), truth].mean() for s in scales]
    model.scale = float(scales[int(np.argmin(losses))])
    for i in range(len(model.langs)):
        own = ce[truth == i, i]
        if len(own) >= 20:
            model.limits[i] = np.quantile(own, 0.995)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected, cross_entropy) for each row.

    A null text or one without a letter is `und` with score 0, as is every text
    if no language was learned. Any other text gets the learned language of
    lowest cross-entropy; ties go to the first by name. `rejected` marks
    answers whose cross-entropy is beyond what the language's own snippets
    have. Only the text is looked at; repeated rows get equal answers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[doc_id].dataType.simpleString()
    slice_bytes = max((2 << 20) // max(len(model.langs), 2), 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            for part in text_slices(batch, 1, slice_bytes):
                bodies = [t or "" for t in part.column(1).to_pylist()]
                ce, sizes = held.cross_entropies(bodies)
                n = len(bodies)
                lang, score, rejected, best_ce = ["und"] * n, np.zeros(n), np.zeros(n, bool), [None] * n
                if held.langs:
                    best = ce.argmin(axis=1)
                    chance = np.exp(_log_posterior(held, ce, sizes, held.scale))[np.arange(n), best]
                    for i, body in enumerate(bodies):
                        if sizes[i]:
                            k = int(best[i])
                            lang[i], score[i] = held.langs[k], chance[i]
                            best_ce[i] = float(ce[i, k])
                            rejected[i] = ce[i, k] > held.limits[k]
                        elif any(c.isalpha() for c in body):
                            # Letters that no model knows: the most common language, with no confidence.
                            lang[i], rejected[i] = held.langs[held.common], True
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), pa.array(best_ce, pa.float64())],
                    [doc_id, "lang_pred", "score", "rejected", "cross_entropy"],
                )

    schema = f"`{doc_id}` {id_type}, lang_pred string, score double, rejected boolean, cross_entropy double"
    return docs.select(doc_id, text).mapInArrow(run, schema)
