import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spokeworks.llm import divergence as Q


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts_of_hard_rows(hard_docs):
    rows = Q.quality_rules(hard_docs).collect()
    want = sorted(((r.doc_id, *base(r.text)) for r in hard_docs.collect()), key=repr)
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_repeats_with_few_hash_bits(spark, monkeypatch):
    """With nearly all bits for the position most windows clash, and texts outgrow the positions: words decide."""
    texts = ["a b c a b c d e f a b", "x y z", "a a a a", "q w e r t y q w e u i o", " ".join(str(i % 7) for i in range(40)), " ".join(map(str, range(30)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'en' AS lang")
    for bits in (3, 61):
        monkeypatch.setattr(Q, "_BITS", bits)
        got = {r.doc_id: r.n_repeat_words for r in Q.quality_rules(docs).collect()}
        assert got == {i: base(t)[4] for i, t in enumerate(texts)}


def test_distance_of_known_shares(spark):
    from pyspark.sql import functions as F

    cases = [([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.2, 0.8], [0.6, 0.4])]
    rows = spark.createDataFrame(cases, "p array<double>, q array<double>").select(Q.jensen_shannon(F.col("p"), F.col("q"))).collect()
    for (p, q), (got,) in zip(cases, rows):
        p, q = np.array(p), np.array(q)
        m = (p + q) / 2
        kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
        assert abs(got - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-9


def test_junk_goes_and_clean_text_stays(small, labels):
    docs = small("documents", "0.01")
    rows = Q.quality_rules(docs).join(labels, "doc_id").collect()
    assert not any(r.kept for r in rows if r.quality == 0)
    clean = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    assert np.mean(clean) > 0.99


def _distance(p, q):
    p, q = np.array(p), np.array(q)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = [np.where(a > 0, a * np.log2(2 * a / (a + b)), 0.0) for a, b in ((p, q), (q, p))]
    return float(np.sqrt(max((terms[0] + terms[1]).sum() / 2, 0.0)))


def _classes(text):
    import regex

    counts = []
    for name in Q.CLASSES[:-1]:
        after = regex.sub(Q._PATTERNS[name], "", text)
        counts.append(len(text) - len(after))
        text = after
    return np.array([*counts, len(text)], float)


def brute(rows):
    """Counts, distances and verdict of every row of a table, from references over all of it."""
    texts = [(r.doc_id, r.lang, r.text or "") for r in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for _, _, t in texts]
    classes, counts = {}, {}
    for (_, lang, text), w in zip(texts, words):
        classes[lang] = classes.get(lang, 0) + _classes(text)
        counts.setdefault(lang, Counter()).update(w)
    out = {}
    for (doc_id, lang, text), w in zip(texts, words):
        own, total = Counter(w), sum(counts[lang].values())
        common = sorted(counts[lang], key=lambda x: (-counts[lang][x], x))[:24]
        shares = [counts[lang][v] / total for v in common]
        mine = [own[v] / max(len(w), 1) for v in common]
        far = _distance(_classes(text) / max(len(text), 1), classes[lang] / max(classes[lang].sum(), 1))
        odd = _distance([*mine, max(1 - sum(mine), 0)], [*shares, 1 - sum(shares)])
        n = base(text)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        out[doc_id] = (*n, failed, not failed and (total < 2_000 or (far <= 0.28 and odd <= 0.45)), far, odd)
    return out


def test_a_whole_table_against_plain_python(spark, small):
    rows = small("documents", "0.01").select("doc_id", "lang", "text").collect()
    want = brute(rows)
    got = Q.quality_rules(small("documents", "0.01")).collect()
    assert len(got) == len(want)
    for r in got:
        told = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
        assert told == want[r.doc_id][:7]
        assert np.allclose([r.class_distance, r.word_distance], want[r.doc_id][7:], atol=1e-9)


def test_a_text_beyond_the_positions(spark):
    """2.2 million words with repeats, among them windows that only words tell apart, in linear time."""
    import time

    text = " ".join(f"w{i % 1_900_000}" for i in range(2_200_000))
    docs = spark.createDataFrame([(1, text, "en")], "doc_id bigint, text string, lang string")
    start = time.time()
    row = Q.quality_rules(docs).first()
    assert (row.n_words, row.n_repeat_words) == (2_200_000, 600_000)
    assert time.time() - start < 90


def test_no_python_in_the_plan(small):
    plan = Q.quality_rules(small("documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(hard_docs):
    assert Q.quality_rules(hard_docs.limit(0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0babA#|é", max_size=60), min_size=1, max_size=6))
def test_base_counts_of_any_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'en' AS lang")
    assert {r.doc_id: tuple(r)[1:6] for r in Q.quality_rules(docs).collect()} == {i: base(t) for i, t in enumerate(texts)}
