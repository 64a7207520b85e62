"""Attention-based multiple-instance learning of document quality.

A document is a bag of passages and only the bag has a label. Every passage is
encoded; gated attention gives each one a weight that is learned together with
the encoder from document labels; the weighted mean of the passages' codes is
scored. Long documents have as many passages as they need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.labelled import SAMPLE_DOCS, labelled_sample
from spokeworks.llm.textbytes import SOLID, gram_hashes, text_slices, utf8_bytes, word_hashes, word_spans

PASSAGE_WORDS = 64
_KINDS = 14
_SLOTS = 64
WIDTH = _KINDS * _KINDS + _SLOTS + 8
CODES = 32


def _byte_kinds() -> np.ndarray:
    """A coarse class for every byte: kinds of letters, digits, spaces, marks, bytes outside ASCII."""
    kinds = np.full(256, 10, np.uint8)
    kinds[[*b"bcdfghjklmnpqrstvwxyz"]] = 0
    kinds[[*b"aeiou"]] = 1
    kinds[65:91] = 2
    kinds[48:58] = 3
    kinds[[*b" \t\r\x0b\x0c"]] = 4
    kinds[10] = 5
    kinds[[*b".,;:"]] = 6
    kinds[[*b"!?"]] = 7
    kinds[[*b"#*$%&@^~+="]] = 8
    kinds[[*b"|<>{}[]()\\/_"]] = 9
    kinds[[*b"'\"-`"]] = 11
    kinds[0x80:0xC0] = 12
    kinds[0xC0:] = 13
    return kinds


_KIND = _byte_kinds()


def encode_passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One row of features for every passage, and the number of passages of each text.

    A passage is 64 words with what separates them. A text without words is one
    passage. Features: frequencies of neighbouring byte kinds, hashed words, and
    how much the passage and its text repeat themselves.
    """
    data, offsets = utf8_bytes(texts)
    starts, lengths, counts = word_spans(data, offsets, SOLID)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    passages = np.maximum(-(-counts // PASSAGE_WORDS), 1)
    total = int(passages.sum())
    base = np.concatenate([[0], np.cumsum(passages)])
    out = np.zeros((total, WIDTH), np.float32)
    row_of_word = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(starts)) - firsts[row_of_word]
    passage = base[row_of_word] + place // PASSAGE_WORDS
    # Bytes belong to the passage of the last word that began before them.
    heads = np.flatnonzero(place % PASSAGE_WORDS == 0)
    begins = offsets[:-1].repeat(passages)
    begins[passage[heads]] = np.where(place[heads] == 0, offsets[row_of_word[heads]], starts[heads])
    owner = np.zeros(len(data) + 1, np.int32)
    np.add.at(owner, begins[1:], 1)
    owner = np.cumsum(owner[:-1], dtype=np.int32)
    if len(data):
        kind = _KIND[data].astype(np.int32)
        pair = owner[1:] * (_KINDS * _KINDS) + kind[:-1] * _KINDS + kind[1:]
        inside = np.ones(len(data) + 1, dtype=bool)
        inside[offsets] = False  # no pair reaches over from the text before
        grid = np.bincount(pair[inside[1:-1]], minlength=total * _KINDS * _KINDS)[: total * _KINDS * _KINDS].reshape(total, -1)
        size = np.maximum(grid.sum(axis=1, keepdims=True), 1)
        out[:, : _KINDS * _KINDS] = np.sqrt(grid / size)
    if len(starts):
        words = word_hashes(data, starts, lengths)
        n = np.bincount(passage, minlength=total)
        slot = (words % np.uint64(_SLOTS)).astype(np.int64)
        hashed = np.bincount(passage * _SLOTS + slot, minlength=total * _SLOTS).reshape(total, _SLOTS)
        at = _KINDS * _KINDS
        out[:, at : at + _SLOTS] = np.sqrt(hashed / np.maximum(n, 1)[:, None])
        at += _SLOTS
        out[:, at] = np.log1p(n) / 5
        out[:, at + 1] = np.bincount(passage, lengths, total) / np.maximum(n, 1) / 10
        out[:, at + 2] = _repeats(passage, words, total)
        trigrams = gram_hashes(words, 3)
        same = row_of_word[: len(trigrams)] == row_of_word[2:] if len(trigrams) else np.zeros(0, bool)
        out[:, at + 3] = _repeats(passage[: len(trigrams)][same], trigrams[same], total)
        # What the whole text repeats, carried by each of its passages.
        texts_n = len(counts)
        out[:, at + 4] = np.repeat(_repeats(row_of_word, words, texts_n), passages)
        out[:, at + 5] = np.repeat(_repeats(row_of_word[: len(trigrams)][same], trigrams[same], texts_n), passages)
        out[:, at + 6] = np.repeat(np.log1p(counts) / 10, passages)
        again = np.concatenate([[False], (words[1:] == words[:-1]) & (row_of_word[1:] == row_of_word[:-1])])
        out[:, at + 7] = np.bincount(passage, again, total) / np.maximum(n, 1)
    return out, passages


def _repeats(group: np.ndarray, item: np.ndarray, groups: int) -> np.ndarray:
    """For each group the share of its items that repeat an earlier one."""
    n = np.bincount(group, minlength=groups)
    if not len(item):
        return np.zeros(groups)
    # One sort of mixed keys; equal keys are equal (group, item) pairs.
    keys = np.sort((item ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(1))
    again = len(keys) and np.concatenate([[False], keys[1:] == keys[:-1]])
    if not again.any():
        return np.zeros(groups)
    order = np.lexsort((item, group))
    g, x = group[order], item[order]
    repeat = np.concatenate([[False], (g[1:] == g[:-1]) & (x[1:] == x[:-1])])
    return np.bincount(g, repeat, groups) / np.maximum(n, 1)


@dataclass
class Model:
    """Encoder, gated attention and output layer; all plain arrays."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, features: np.ndarray, passages: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_forward(self.weights, (features - self.mean) / self.scale, passages)[0]))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, passages: np.ndarray):
    starts = np.concatenate([[0], np.cumsum(passages)[:-1]])
    code = np.tanh(x @ w["E"] + w["e"])
    value, gate = np.tanh(code @ w["V"]), 1 / (1 + np.exp(-(code @ w["U"])))
    raw = (value * gate) @ w["a"]
    top = np.repeat(np.maximum.reduceat(raw, starts), passages)
    weight = np.exp(raw - top)
    weight /= np.repeat(np.add.reduceat(weight, starts), passages)
    bag = np.add.reduceat(weight[:, None] * code, starts)
    return bag @ w["o"] + w["b"][0], (starts, code, value, gate, weight, bag)


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy of documents, with a small penalty on the encoder's weights."""
    logit, (starts, code, value, gate, weight, bag) = _forward(w, x, n)
    d_logit = (1 / (1 + np.exp(-logit)) - labels) / len(labels)
    grads = {"o": bag.T @ d_logit, "b": np.array([d_logit.sum()])}
    d_bag = np.repeat(d_logit, n)[:, None] * w["o"]
    d_code = weight[:, None] * d_bag
    pull = (d_bag * code).sum(axis=1)
    d_raw = weight * (pull - np.repeat(np.add.reduceat(weight * pull, starts), n))
    both = value * gate
    grads["a"] = both.T @ d_raw
    d_both = d_raw[:, None] * w["a"]
    d_value, d_gate = d_both * gate * (1 - value**2), d_both * value * gate * (1 - gate)
    grads["V"], grads["U"] = code.T @ d_value, code.T @ d_gate
    d_code += d_value @ w["V"].T + d_gate @ w["U"].T
    d_in = d_code * (1 - code**2)
    grads["E"], grads["e"] = x.T @ d_in + 1e-4 * w["E"], d_in.sum(axis=0)
    return grads


def _moments(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of every feature, from slices."""
    n, total, squares = max(len(features), 1), np.zeros(WIDTH), np.zeros(WIDTH)
    for at in range(0, len(features), 4096):
        part = features[at : at + 4096].astype(np.float64)
        total += part.sum(axis=0)
        squares += (part * part).sum(axis=0)
    mean = total / n
    return mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)) + 0.02


def fit(features: np.ndarray, passages: np.ndarray, labels: np.ndarray, epochs: int = 40, seed: int = 3) -> Model:
    """Adam on the cross-entropy of document labels, in mini-batches of whole documents.

    Features may have half precision; only a mini-batch of them is unpacked at a time.
    Without both kinds of labels the model gives their mean, or 0.5 if there are none.
    """
    draw = np.random.default_rng(seed)
    mean, scale = _moments(features)
    w = {
        "E": draw.normal(0, WIDTH**-0.5, (WIDTH, CODES)), "e": np.zeros(CODES),
        "V": draw.normal(0, CODES**-0.5, (CODES, 16)), "U": draw.normal(0, CODES**-0.5, (CODES, 16)),
        "a": draw.normal(0, 0.25, 16), "o": np.zeros(CODES), "b": np.zeros(1),
    }
    share = float(np.clip(labels.mean(), 0.005, 0.995)) if len(labels) else 0.5
    w["b"][0] = np.log(share / (1 - share))
    model = Model(mean.astype(np.float32), scale.astype(np.float32), w)
    if not 0 < labels.sum() < len(labels):
        return model
    begins = np.concatenate([[0], np.cumsum(passages)])
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        order = draw.permutation(len(labels))
        for at in range(0, len(order), 128):
            docs = order[at : at + 128]
            n = passages[docs]
            own = np.concatenate([np.arange(begins[d], begins[d + 1]) for d in docs])
            part = (features[own].astype(np.float32) - model.mean) / model.scale
            grads = _gradients(w, part, n, labels[docs])
            step += 1
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE_DOCS) -> Model:
    """Fit on at most `most` labelled documents; their passages are encoded in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 0):
                x, n = encode_passages(part.column(0))
                cut = np.split(x.astype(np.float16), np.cumsum(n)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array([c.tobytes() for c in cut], pa.binary())], ["label", "x"]
                )

    sample = labelled_sample(docs, labels, label, doc_id, text, most)
    order = F.xxhash64("x"), F.col("label")
    rows = sample.mapInArrow(run, "label double, x binary").orderBy(*order).toArrow()
    bags = rows.column("x").combine_chunks().cast(pa.large_binary())
    if not len(bags):
        return fit(np.zeros((0, WIDTH), np.float16), np.zeros(0, np.int64), np.zeros(0))
    offsets = np.frombuffer(bags.buffers()[1], np.int64)[: len(bags) + 1]
    features = np.frombuffer(bags.buffers()[2], np.float16, offsets[-1] // 2).reshape(-1, WIDTH)
    return fit(features, np.diff(offsets) // (2 * WIDTH), rows.column("label").to_numpy())


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", cut: float = 0.3, keep: bool = False) -> DataFrame:
    """(id, score, predicted) for each row, or with `keep` all columns of the rows predicted 1.

    Only the text is looked at. Null and empty texts are one passage without
    words, so they get a score too; repeated rows get equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text) if keep else 1
    rows = docs if keep else docs.select(doc_id, text)
    schema = docs.schema if keep else f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, at, 1 << 20):
                # Rounded, as sums depend on what shares a batch in the last digits.
                found = np.round(sent.value.scores(*encode_passages(part.column(at))).astype(np.float64), 9)
                if keep:
                    yield part.filter(pa.array(found >= cut))
                else:
                    ones = pa.array((found >= cut).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), ones], [doc_id, "score", "predicted"])

    return rows.mapInArrow(run, schema)
