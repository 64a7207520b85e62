import hashlib
import re

import pytest

from spokeworks.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def expected(text, items, window=13):
    w, hit, met = words(text), set(), set()
    for name, body in items:
        v = words(body)
        size = min(window, len(v))
        for k in range(len(v) - size + 1 if size else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == v[k : k + size]:
                    hit.update(range(i, i + size))
                    met |= {name} - {None}
    digest = hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest()
    return len(w), len(hit), len(met), digest, bool(hit) and 20 * len(hit) >= len(w)


BENCH = [
    (1, "the same three words the same three words and then some more words to make a window"),
    (10, "Two WORDS"),
    (2, "words"),
    (3, None),
    (4, "?!"),
    (None, "one"),
    (5, "a a a a a a a a a a a a a a a"),
    (6, "a a b"),
    (7, "x a a b"),
    (7, "same text again the same text again the same text again the same text again"),
]
EXTRA = ["a a a b a a", "q x a a b a a a a a a a a a a a a a a a a b", "a " * 14 + "b", "Then SOME more words to make a window x to make a window"]


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 5])
def test_against_brute_force(spark, hard_docs, block_words):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    docs = hard_docs.filter("length(text) < 5000 or text is null").select("doc_id", "text", "hits")
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, "") for i, t in enumerate(EXTRA)], docs.schema))
    got = D.contamination_report(D.find_matches(docs, bench, block_words=block_words)).drop("longest_span").collect()
    want = [(r.doc_id, *expected(r.text, BENCH)) for r in docs.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_tables_and_long_texts(spark, hard_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = D.contamination_report(D.find_matches(hard_docs, none)).collect()
    assert len(rows) == hard_docs.count() and not any(r.n_hit for r in rows)
    assert max(r.n_words for r in rows) == 120_000
    assert D.find_matches(hard_docs.limit(0), none).count() == 0


def test_cutting_long_spans(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Before. {item}, after w1 w2"), (2, "clean"), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    matched = docs.join(D.find_matches(docs, bench).select("doc_id", "hits"), "doc_id")
    assert {r.doc_id: r.text for r in D.cut_spans(matched).collect()} == {1: "Before. , after w1 w2", 2: "clean", 3: None}


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 5])
@pytest.mark.parametrize("longest", [None, 2])
def test_kept_rows_against_brute_force(spark, hard_docs, block_words, longest):
    """Rows are judged where they lie: those without id too, and every column stays."""
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    docs = hard_docs.filter("length(text) < 5000 or text is null")
    more = spark.createDataFrame([(None, BENCH[0][1]), (None, BENCH[0][1]), (None, "clean " * 9), (900, EXTRA[0])], "doc_id bigint, text string")
    docs = docs.withColumn("_hits", docs["hits"]).unionByName(more, allowMissingColumns=True)
    got = D.keep_clean(docs, bench, block_words=block_words, cut_longer_than=longest)
    assert got.columns == docs.columns
    clean = [r for r in docs.collect() if not expected(r.text, BENCH)[4]]
    if longest is None:
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, clean), key=repr)
    else:
        assert sorted((r.doc_id, bool(r.text)) for r in got.filter("doc_id is not null").collect()) == sorted((r.doc_id, bool(r.text)) for r in clean if r.doc_id is not None)
    assert D.keep_clean(docs.limit(0), bench).count() == 0
    assert D.keep_clean(docs, bench.limit(0)).count() == docs.count()


def test_cut_of_rows_that_stay(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rest = " ".join(f"clean{i}" for i in range(400))
    docs = spark.createDataFrame([(1, f"{rest} {item}, {rest}"), (2, item), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([("x", item)], "item_id string, text string")
    assert {r.doc_id: r.text for r in D.keep_clean(docs, bench, cut_longer_than=12).collect()} == {1: f"{rest} , {rest}", 3: None}
    assert {r.doc_id: r.text for r in D.keep_clean(docs, bench).collect()} == {1: f"{rest} {item}, {rest}", 3: None}


@pytest.mark.parametrize("kind", ["smallint", "decimal(10,2)", "date"])
def test_items_of_any_id_type(spark, kind):
    bench = spark.createDataFrame([("2024",)], "i string").selectExpr(f"CAST(IF('{kind}' = 'date', '2024-01-01', i) AS {kind}) AS item_id", "'one two three' AS text")
    docs = spark.createDataFrame([(1, "one two three four")], "doc_id bigint, text string")
    assert [r.item_id for r in bench.collect()] == D.find_matches(docs, bench).first()["items"]
