import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_one_row_of_exact_copies_stays(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1))] * 50 + [(2, text(1)), (3, text(3)), (4, ""), (5, None)]
    rows += [(None, text(6))] * 40 + [(None, text(1))] * 3 + [(None, None), (None, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    expected = [(1, text(1)), (3, text(3)), (4, ""), (5, None), (None, text(6)), (None, None), (None, None), (None, " ")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(expected, key=repr)


def test_distinct_documents_pass_untouched(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in range(9)], SCHEMA)
    assert corpus_pipeline._single(docs) is docs
