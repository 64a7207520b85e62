"""Models against plain loops: the forward pass and gradients, Kneser-Ney probabilities, the ordinal likelihood."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spokeworks.llm import attention, langid, severity
from spokeworks.llm.tables import held_out


def sigmoid(x):
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def logit_by_hand(w, passages):
    """Score of one document before the last squashing, one number at a time."""
    codes, raws = [], []
    for x in passages:
        code = [math.tanh(sum(x[i] * w["E"][i][k] for i in range(len(x))) + w["e"][k]) for k in range(len(w["e"]))]
        value = [math.tanh(sum(code[i] * w["V"][i][k] for i in range(len(code)))) for k in range(len(w["a"]))]
        gate = [sigmoid(sum(code[i] * w["U"][i][k] for i in range(len(code)))) for k in range(len(w["a"]))]
        codes.append(code)
        raws.append(sum(v * g * a for v, g, a in zip(value, gate, w["a"])))
    weights = [math.exp(r - max(raws)) for r in raws]
    bag = [sum(weight * code[k] for weight, code in zip(weights, codes)) / sum(weights) for k in range(len(w["e"]))]
    return sum(b * o for b, o in zip(bag, w["o"])) + w["b"][0]


@pytest.fixture(scope="module")
def small_net():
    draw = np.random.default_rng(4)
    shapes = {"E": (5, 4), "e": (4,), "V": (4, 3), "U": (4, 3), "a": (3,), "o": (4,), "b": (1,)}
    w = {k: draw.normal(size=s) for k, s in shapes.items()}
    n = np.array([3, 1, 4])
    return w, draw.normal(size=(8, 5)), n, np.array([1.0, 0.0, 0.25])


def test_forward_pass(small_net):
    w, x, n, _ = small_net
    got = attention._forward(w, x, n)[0]
    want = [logit_by_hand(w, part.tolist()) for part in np.split(x, np.cumsum(n)[:-1])]
    np.testing.assert_allclose(got, want, rtol=1e-10)


def test_gradients_of_the_loss(small_net):
    w, x, n, labels = small_net

    def loss(v):
        logits = [logit_by_hand(v, part.tolist()) for part in np.split(x, np.cumsum(n)[:-1])]
        entropy = -sum(y * math.log(sigmoid(z)) + (1 - y) * math.log(1 - sigmoid(z)) for y, z in zip(labels, logits)) / len(labels)
        return entropy + 0.5e-4 * float((v["E"] ** 2).sum())

    grads = attention._gradients(w, x, n, labels)
    for name, g in grads.items():
        for at in np.ndindex(g.shape):
            moved = []
            for step in (1e-5, -1e-5):
                other = {k: v.copy() for k, v in w.items()}
                other[name][at] += step
                moved.append(loss(other))
            assert g[at] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-7), (name, at)


def test_quality_query_row_by_row(spark, small):
    """All rows of a table: features of each text alone, then the plain forward pass."""
    docs = small("documents")
    model = attention.train(docs, small("labels"))
    got = {r.doc_id: r for r in attention.score(docs, model).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: len(r.text))[:60]:
        x, n = attention.encode_passages(pa.array([r.text]))
        scaled = ((x - model.mean) / model.scale).astype(float)
        assert len(scaled) == n[0] == max(-(-len(r.text.split()) // 64), 1)
        want = sigmoid(logit_by_hand({k: v.tolist() for k, v in model.weights.items()}, scaled.tolist()))
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-4)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


class PlainModel:
    """Interpolated Kneser-Ney over one language's texts, in dictionaries of strings."""

    def __init__(self, texts, alphabet):
        self.counts = {4: Counter()}
        for t in texts:
            self.counts[4].update(t[i - 3 : i + 1] for i in range(3, len(t)))
        for n in (3, 2, 1):  # how many different characters come before
            self.counts[n] = Counter(gram[1:] for gram in self.counts[n + 1])
        self.total, self.kinds = defaultdict(int), defaultdict(int)
        for n in self.counts:
            for gram, c in self.counts[n].items():
                self.total[n, gram[:-1]] += c
                self.kinds[n, gram[:-1]] += 1
        self.floor = 1 / (alphabet + 1)

    def p(self, gram):
        n = len(gram)
        if not n:
            return self.floor
        shorter = self.p(gram[1:])
        total = self.total[n, gram[:-1]]
        if not total:
            return shorter
        d = langid.DISCOUNT
        return max(self.counts[n][gram] - d, 0) / total + d * self.kinds[n, gram[:-1]] / total * shorter


def plain_text(text):
    """Lower-cased letters, every run of others after a letter one space, three before."""
    out = "   "
    for c in (text or "").lower():
        if c.isalpha():
            out += c
        elif not out.endswith(" "):
            out += " "
    return out


def test_probabilities_of_every_gram():
    texts = {"a": ["hello there, general kenobi", "hello again"], "b": ["la casa de la playa", "esta aqui"], "c": ["zz"]}
    plain = {k: [plain_text(t) for t in v] for k, v in texts.items()}
    counts = {}
    for k, v in texts.items():
        keys = np.concatenate([langid.gram_keys(langid.normalised(t), 4) for t in v])
        counts[k] = np.unique(keys, return_counts=True)
    model = langid.build_model(["a", "b", "c"], counts)
    alphabet = len({c for v in plain.values() for t in v for c in t[3:]})
    by_hand = [PlainModel(plain[k], alphabet) for k in "abc"]
    asked = ["hello world", "la casa", "zzz zz", "q", "", "general de la zz", "xyz hello"]
    ce, sizes = model.cross_entropies(asked)
    for t, row, size in zip(asked, ce, sizes):
        p = plain_text(t)
        assert size == len(p) - 3
        for m, got in zip(by_hand, row):
            want = -sum(math.log(m.p(p[i - 3 : i + 1])) for i in range(3, len(p))) / max(size, 1)
            assert got == pytest.approx(want, rel=2e-5, abs=1e-6)


def test_language_query_row_by_row(spark, small):
    """All rows of a table by models in dictionaries, from the very texts that the sample has."""
    from pyspark.sql import functions as F

    docs = small("documents")
    model = langid.train(docs)
    # The sample is every document that may be learned from; a fifth by hash is set aside.
    h = F.xxhash64(F.lit(5), F.col("doc_id"))
    rows = docs.filter(~held_out("doc_id") & F.col("lang").isNotNull()).select("lang", "text", h.alias("h")).collect()
    first = {}
    for r in rows:
        first[r.lang] = min(first.get(r.lang, r.h), r.h)
    learned = [r for r in rows if r.h % 5 != 0 or r.h == first[r.lang]]
    texts = {x: [plain_text(r.text) for r in learned if r.lang == x] for x in model.langs}
    alphabet = len({c for v in texts.values() for t in v for c in t[3:]})
    by_hand = [PlainModel(texts[x], alphabet) for x in model.langs]
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    asked = sorted(docs.select("doc_id", "text").collect(), key=lambda r: len(r.text or ""))[:80]
    for r in asked:
        p = plain_text(r.text)
        if not any(c.isalpha() for c in p):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        ce = [-sum(math.log(m.p(p[i - 3 : i + 1])) for i in range(3, len(p))) / (len(p) - 3) for m in by_hand]
        best = int(np.argmin(ce))
        assert got[r.doc_id].lang_pred == model.langs[best]
        raw = [-x * model.scale * (len(p) - 3) for x in ce]
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(x - max(raw)) for x in raw), abs=1e-3)


def test_ordinal_gradients():
    draw = np.random.default_rng(8)
    rows = [np.flatnonzero(draw.random(6) < 0.5) for _ in range(30)]
    grades = draw.integers(0, 4, 30)
    w, first, gaps = draw.random(6), np.array([0.3]), np.array([-0.2, 0.4])

    def loss(w, first, gaps):
        t = [first[0], first[0] + math.exp(gaps[0]), first[0] + math.exp(gaps[0]) + math.exp(gaps[1])]
        total = 0.0
        for row, g in zip(rows, grades):
            signal = sum(w[i] for i in row)
            above = [1.0, *(sigmoid(signal - x) for x in t), 0.0]
            total -= math.log(above[g] - above[g + 1])
        return total / len(rows) + 0.01 * sum(w)

    of = np.repeat(np.arange(30), [len(r) for r in rows])
    grads = severity._gradients((of, np.concatenate(rows), 30), grades, w, first, gaps, 0.01)
    for which, g in enumerate(grads):
        for k in range(len(g)):
            moved = []
            for step in (1e-6, -1e-6):
                args = [w.copy(), first.copy(), gaps.copy()]
                args[which][k] += step
                moved.append(loss(*args))
            assert g[k] == pytest.approx((moved[0] - moved[1]) / 2e-6, abs=1e-6), (which, k)


def test_toxicity_query_row_by_row(spark, small):
    docs = small("documents", "0.01")
    model = severity.train(docs, small("labels", "0.01"))
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in severity.score(docs, model).collect()}
    assert len(got) == len(rows) and model.weights
    for r in rows:
        signal = sum(model.weights.get(f, 0.0) for f in severity.features(r.text))
        above = [sigmoid(signal - t) for t in model.thresholds]
        mine = got[r.doc_id]
        assert mine.score == pytest.approx(above[0], abs=1e-9) and mine.severity == pytest.approx(sum(above), abs=1e-9)
        assert mine.toxic == (above[0] >= 0.25) and mine.grade == sum(p >= 0.5 for p in above)


def test_samples_are_bounded(spark, small):
    """One row for each id, and no more bytes than allowed, however often ids and long texts occur."""
    from spokeworks.llm.labelled import labelled_sample

    docs = small("documents", "0.01").select("doc_id", "text")
    more = docs.unionByName(docs).unionByName(docs.selectExpr("doc_id", "concat('other ', text) AS text"))
    labels = small("labels", "0.01")
    once = labelled_sample(docs, labels, "quality").collect()
    again = labelled_sample(more, labels, "quality")
    assert again.count() == len(once)
    few = labelled_sample(more, labels, "quality", most_bytes=50_000).collect()
    assert 5 < len(few) < len(once) and sum(len(r.text.encode()) for r in few) <= 50_000
    assert {r.text for r in few} <= {r.text for r in again.collect()}
