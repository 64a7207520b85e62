"""Quality, toxicity and language models: held-out accuracy, and defined results for hard rows."""

import numpy as np
import pytest

from spokeworks.llm import attention, langid, severity
from spokeworks.llm.tables import held_out


@pytest.fixture(scope="module")
def docs(small):
    return small("documents", "0.01")


@pytest.fixture(scope="module")
def quality_model(docs, labels):
    return attention.train(docs, labels)


@pytest.fixture(scope="module")
def toxic_model(docs, labels):
    return severity.train(docs, labels)


@pytest.fixture(scope="module")
def language_model(docs):
    return langid.train(docs)


def test_quality_of_held_out_documents(docs, labels, quality_model):
    rows = attention.score(docs, quality_model).join(labels, "doc_id").filter(held_out("doc_id")).collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_attention_gradients():
    draw = np.random.default_rng(0)
    passages = np.array([2, 1, 3])
    x = draw.normal(size=(6, attention.WIDTH)).astype(np.float32)
    model = attention.fit(x, passages, np.array([0.0, 1.0, 1.0]), epochs=60)
    assert list(np.round(model.scores(x, passages))) == [0, 1, 1]


def test_encoding_does_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["word " * 130, None, "", "x", "é ñ " * 40, "\n\n a"]
    together, n = attention.encode_passages(pa.array(texts, pa.string()))
    alone = [attention.encode_passages(pa.array([t], pa.string()))[0] for t in texts]
    assert [len(a) for a in alone] == n.tolist() == [3, 1, 1, 1, 2, 1]
    np.testing.assert_allclose(together, np.concatenate(alone), atol=2e-2)


def test_toxicity_of_held_out_documents(small):
    docs, labels = small("documents", "0.1"), small("labels", "0.1")
    scored = severity.score(docs, severity.train(docs, labels))
    rows = scored.join(labels.withColumnRenamed("toxic", "truth"), "doc_id").filter(held_out("doc_id")).collect()
    clean = [r.toxic for r in rows if r.truth == 0]
    assert np.mean(clean) < 0.02
    toxic = [r.toxic for r in rows if r.truth == 1 and r.quality == 1]
    assert len(toxic) > 50 and np.mean(toxic) > 0.95


def test_ordinal_model_orders_grades(spark):
    draw = np.random.default_rng(1)
    texts, grades = [], []
    for grade in range(4):
        for _ in range(60):
            texts.append(" ".join([*(f"bad{'abcdef'[k]}" for k in range(2 * grade)), *(f"w{'abcdefghij'[draw.integers(10)]}x" for _ in range(5))]))
            grades.append(grade)
    sample = spark.createDataFrame([(t, float(g > 0)) for t, g in zip(texts, grades)], "text string, label double")
    names = severity.select_features(sample)
    assert names and all(f.startswith("bad") for f in names)
    rows = [np.array([i for i, f in enumerate(names) if f in severity.features(t)]) for t in texts]
    model = severity.fit(rows, names, np.array(grades), 3)
    assert (np.diff(model.thresholds) > 0).all()
    signal = np.array([sum(model.weights.get(f, 0) for f in severity.features(t)) for t in texts])
    expected = model.above(signal).sum(axis=1)
    means = [expected[np.array(grades) == g].mean() for g in range(4)]
    assert means == sorted(means) and np.abs(np.array(means) - np.arange(4)).max() < 0.4


def test_language_of_held_out_documents(docs, language_model):
    rows = langid.identify(docs, language_model).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out("doc_id")).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_character_model_sums_to_one():
    texts = {"a": "hello there general kenobi hello", "b": "la casa de la playa esta aqui"}
    units = {k: langid.normalised(t) for k, t in texts.items()}
    model = langid.build_model(["a", "b"], {k: np.unique(langid.gram_keys(u, 4), return_counts=True) for k, u in units.items()})
    alphabet = np.unique(np.concatenate([*units.values(), [np.uint64(ord("~"))]]))
    for context in ("hel", "zzz", " la", "elz"):
        head = 0
        for c in context:
            head = (head | ord(c)) << 16
        keys = np.array([head | int(c) for c in alphabet], np.uint64)
        # The unknown character stands for all that were never seen.
        np.testing.assert_allclose(np.exp(model._log_probabilities(keys, 4)).sum(axis=0), 1, atol=1e-4)


def test_hard_rows(hard_docs, quality_model, toxic_model, language_model):
    n = hard_docs.count()
    for frame in (attention.score(hard_docs, quality_model), severity.score(hard_docs, toxic_model)):
        rows = frame.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
        assert len({tuple(r) for r in rows if r.doc_id == 5}) == 1
    said = {r.doc_id: r for r in langid.identify(hard_docs, language_model).collect()}
    assert [said[i].lang_pred for i in (0, 1, 2, 10)] == ["und", "und", "und", said[10].lang_pred]
    assert said[4].lang_pred in language_model.langs and said[6].lang_pred in language_model.langs
    kept = severity.score(hard_docs, toxic_model, keep=True)
    assert kept.columns == hard_docs.columns and 0 < kept.count() <= n


def test_nothing_to_learn_from(spark, hard_docs, labels):
    none = labels.limit(0)
    model = attention.train(hard_docs, none)
    assert {round(r.score, 6) for r in attention.score(hard_docs, model).collect()} == {0.5}
    rows = severity.score(hard_docs, severity.train(hard_docs, none)).collect()
    assert {r.grade for r in rows} <= {0, 1}
    empty = langid.train(hard_docs.limit(0))
    assert {r.lang_pred for r in langid.identify(hard_docs, empty).collect()} == {"und"}
    for frame in (attention.score(hard_docs.limit(0), model), langid.identify(hard_docs.limit(0), empty)):
        assert frame.count() == 0


def test_held_out_rows_teach_nothing(docs, labels, language_model):
    """Spoilt labels and languages of the held-out fifth change no model."""
    from pyspark.sql import functions as F

    aside = held_out("doc_id")
    spoilt = labels.withColumn("quality", F.when(aside, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = attention.train(docs, labels, most=100), attention.train(docs, spoilt, most=100)
    np.testing.assert_array_equal(a.weights["o"], b.weights["o"])
    other = langid.train(docs.withColumn("lang", F.when(aside, "xx").otherwise(F.col("lang"))))
    assert other.langs == language_model.langs
    np.testing.assert_array_equal(other.log_p[3], language_model.log_p[3])


def test_language_in_a_script_beyond_16_bits(spark):
    gothic = "".join(chr(0x10330 + i % 26) for i in range(40))
    adlam = "".join(chr(0x1E922 + i % 28) for i in range(40))
    rows = [(i, f"{t[i % 7:]} {t}", x) for i in range(90) for t, x in ((gothic, "got"), (adlam, "ff"), ("plain words of no note", "en"))]
    docs = spark.createDataFrame([(k, t, x) for k, (_, t, x) in enumerate(rows)], "doc_id bigint, text string, lang string")
    asked = spark.createDataFrame([(1, gothic[5:30]), (2, adlam[3:25]), (3, "\U0001f600 \U0001f600"), (4, "plain")], "doc_id bigint, text string")
    said = {r.doc_id: r for r in langid.identify(asked, langid.train(docs)).collect()}
    assert [said[i].lang_pred for i in (1, 2, 3, 4)] == ["got", "ff", "und", "en"]
    assert said[1].score > 0.5 and said[2].score > 0.5
