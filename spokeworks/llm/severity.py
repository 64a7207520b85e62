"""Severity of toxic text by cumulative-link ordinal regression on sparse features.

P(grade > k) = sigmoid(w.x - t_k): one weight vector is shared by all ordered
thresholds t_1 < t_2 < ..., and the expected severity is the sum of these
probabilities. Features are the words of a text, and their first characters as
a stand-in for inflections, each present or absent, among those that the sample
shows to be tied to toxicity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spokeworks.llm.labelled import SAMPLE_DOCS, labelled_sample
from spokeworks.llm.tables import written
from spokeworks.llm.textbytes import text_slices

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)


@dataclass
class Model:
    """Weight of each feature, and the thresholds between grades."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def above(self, signal: np.ndarray) -> np.ndarray:
        """P(grade > k) for each signal (row) and threshold (column)."""
        return 1 / (1 + np.exp(-np.clip(signal[:, None] - self.thresholds[None, :], -500, 500)))


def features(text: str | None) -> set[str]:
    """Distinct lower-cased words, and prefixes of longer words marked with a star."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(f"{w[:n]}*" for n in PREFIXES for w in words if len(w) > n)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, yes, no): in how many toxic and other texts of a batch each feature is."""
    for batch in batches:
        for part in text_slices(batch, 0):
            yes, no = Counter(), Counter()
            for body, label in zip(part.column(0), part.column(1)):
                (yes if label.as_py() > 0.5 else no).update(features(body.as_py()))
            names = sorted(yes.keys() | no.keys())
            columns = [pa.array(names, pa.string()), pa.array([yes[f] for f in names], pa.int64()), pa.array([no[f] for f in names], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "yes", "no"])


def select_features(sample: DataFrame, ratio: float = 4.0) -> list[str]:
    """Features `ratio` times as frequent in toxic texts, and more so than chance makes the best of all of them.

    That is a log-likelihood ratio above 2 ln(features) + 2. Counted in tasks;
    the driver gets the chosen ones, of which a bounded sample has few.
    """
    toxic = F.col("label") > 0.5
    n_yes, n_no = sample.agg(F.sum(toxic.cast("bigint")), F.sum((~toxic).cast("bigint"))).first()
    n_yes, n_no = max(n_yes or 0, 1), max(n_no or 0, 1)
    counts = sample.mapInArrow(_feature_counts, "feature string, yes bigint, no bigint").groupBy("feature")
    counts = written(counts.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).filter("yes > 0"), "feature-counts")
    surprise = 2 * float(np.log(max(counts.count(), 1))) + 2
    share = n_yes / (n_yes + n_no)
    both = F.col("yes") + F.col("no")
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    gain = 2 * (part(F.col("yes"), both * share) + part(F.col("no"), both * (1 - share)))
    frequent = F.col("yes") / n_yes >= ratio * (F.col("no") + 0.5) / n_no
    chosen = counts.withColumn("gain", gain).filter(frequent & (F.col("gain") >= surprise))
    return [row["feature"] for row in chosen.orderBy(F.desc("gain"), "feature").collect()]


def _gradients(
    entries: tuple[np.ndarray, np.ndarray, int], grades: np.ndarray, w: np.ndarray, first: np.ndarray, gaps: np.ndarray, lasso: float
) -> list[np.ndarray]:
    """Gradients of the mean negative log-likelihood, with the penalty, for weights, first threshold and log gaps.

    `entries` are the texts and features of all entries that are one, and the number of texts.
    """
    of, at, size = entries
    n = max(size, 1)
    t = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
    signal = np.bincount(of, w[at], size)
    p = 1 / (1 + np.exp(-np.clip(signal[:, None] - t, -50, 50)))
    edges = np.concatenate([np.ones((size, 1)), p, np.zeros((size, 1))], axis=1)
    chosen = np.take_along_axis(edges, grades[:, None], 1) - np.take_along_axis(edges, grades[:, None] + 1, 1)
    chosen = np.maximum(chosen, 1e-9)[:, 0]
    slope = p * (1 - p)
    d = np.zeros_like(p)  # d(-log likelihood) / d(signal - t_k)
    for k in range(len(gaps) + 1):
        d[:, k] = (-(grades == k + 1).astype(float) + (grades == k)) * slope[:, k] / chosen
    d_signal = d.sum(axis=1)
    tail = -np.cumsum(d.sum(axis=0)[::-1])[::-1]
    return [np.bincount(at, d_signal[of], len(w)) / n + lasso, tail[:1] / n, tail[1:] * np.exp(gaps) / n]


def fit(rows: list[np.ndarray], names: list[str], grades: np.ndarray, top: int, steps: int = 1000, lasso: float = 3e-4) -> Model:
    """Maximum likelihood by Adam over the weights, the first threshold and the log gaps above it.

    `rows` holds each text's feature numbers. Grades run from 0 to `top`.
    Weights are kept non-negative, as features were chosen for occurring with
    toxicity, and a penalty on their sum takes those to zero that only occur in
    copies of toxic texts. Without features the thresholds follow the shares of grades.
    """
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    shares = np.array([np.clip((grades > k).mean() if len(grades) else 0.5, 0.002, 0.998) for k in range(top)])
    limits = np.maximum.accumulate(-np.log(shares / (1 - shares)) + 1e-3 * np.arange(top))
    w, first, gaps = np.zeros(len(names)), limits[:1].copy(), np.log(np.maximum(np.diff(limits), 1e-2))
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, first, gaps)]
    for step in range(1, steps + 1 if len(at) else 1):
        grads = _gradients((of, at, len(rows)), grades, w, first, gaps, lasso)
        for value, g, (m, v) in zip((w, first, gaps), grads, state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        np.maximum(w, 0, out=w)
    t = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
    return Model({f: float(x) for f, x in zip(names, w) if x > 1e-3}, t)


def grade_by_evidence(rows: list[np.ndarray], names: list[str], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 from labels that only say whether a text is toxic.

    0 is not toxic. Toxic texts are cut into thirds by how many words they
    have that the sample ties to toxicity: mild, strong, severe.
    """
    word = np.array([not f.endswith("*") for f in names], bool)
    counts = np.array([int(word[r].sum()) if len(r) else 0 for r in rows])
    if not toxic.any():
        return np.zeros(len(rows), np.int64)
    cuts = np.quantile(counts[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (counts > cuts[0]) + (counts > cuts[1]), 0).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", most: int = SAMPLE_DOCS, graded: bool = False) -> Model:
    """Fit on at most `most` labelled documents, half of them toxic if there are as many.

    With `graded` the label is the grade itself; otherwise it is 0 or 1 and
    grades follow from `grade_by_evidence`. The thresholds are then moved so
    that the first one fits the toxic share of all labels, not of the sample.
    The driver gets each text's label and numbers of chosen features.
    """
    sample = written(labelled_sample(docs, labels, label, doc_id, text, most, each=F.col("label") > 0), "toxic-sample")
    names = select_features(sample)
    sent = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            rows = [sorted(number[f] for f in features(x.as_py()) & number.keys()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["label", "row"])

    found = sample.mapInArrow(run, "label double, row array<int>").orderBy("label", "row").toArrow()
    rows = [np.array(r, np.int64) for r in found.column("row").to_pylist()]
    values = np.rint(found.column("label").to_numpy()).astype(np.int64)
    grades = values if graded else grade_by_evidence(rows, names, values > 0)
    model = fit(rows, names, grades, max(int(grades.max(initial=1)), 1))
    real = labels.filter(F.col(label).isNotNull()).agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
    if real and real < 1 and 0 < (values > 0).sum() < len(values):
        there = (values > 0).mean()
        model.thresholds = model.thresholds + np.log(there / (1 - there)) - np.log(real / (1 - real))
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", cut: float = 0.25, keep: bool = False) -> DataFrame:
    """(id, severity, score, grade, toxic) for each row, or with `keep` the untoxic rows as they are.

    `severity` is the expected grade, `score` the chance of a grade above 0,
    `grade` the last one that is likelier exceeded or met than not, and
    `toxic` is 1 if score >= cut. Null and empty texts have no features.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text) if keep else 1
    rows = docs if keep else docs.select(doc_id, text)
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = docs.schema if keep else f"`{doc_id}` {id_type}, severity double, score double, grade int, toxic int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value.weights
        known = weights.keys()
        sizes = [n for n in PREFIXES if any(len(f) == n + 1 and f[-1] == "*" for f in known)]
        for batch in batches:
            signal = np.zeros(batch.num_rows)
            for i, body in enumerate(batch.column(at)):
                words = set(WORD.findall((body.as_py() or "").lower()))
                found = words & known
                for n in sizes:
                    heads = {w[:n] for w in words if len(w) > n}
                    found |= {f"{h}*" for h in heads} & known
                signal[i] = sum(weights[f] for f in sorted(found))
            p = sent.value.above(signal)
            toxic = p[:, 0] >= cut
            if keep:
                yield batch.filter(pa.array(~toxic))
            else:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(p.sum(axis=1)),
                        pa.array(p[:, 0]),
                        pa.array((p >= 0.5).sum(axis=1).astype(np.int32)),
                        pa.array(toxic.astype(np.int32)),
                    ],
                    [doc_id, "severity", "score", "grade", "toxic"],
                )

    return rows.mapInArrow(run, schema)
