"""Small tables that every text operator must cope with."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside.
CLASHES = ["id", "label", "n", "h", "part", "rank", "block", "range", "regs", "key", "hits", "items", "score", "toxic", "kept", "_id", "_text", "lang_pred", "start", "length", "offset", "shard", "t"]

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))
TEXTS = [
    None,
    "",
    " \n\t\x0b",
    "one",
    "Two words",
    "the same three words the same three words",
    "Éa ñandú 中文 \U0001f600 İstanbul ﬁ",
    "a b c \u0085 d",
    "THE SAME TEXT AGAIN " * 30,
    "THE SAME TEXT AGAIN " * 30,
    "123 456 !!! ### <|endoftext|> <|im_end|> \\ \\n",
    LONG,
    LONG.replace("word5 ", "changed "),
]


def hard_rows():
    rows = [(i, text, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 2}", None) for i, text in enumerate(TEXTS)]
    # Repeated rows, and rows without any value.
    return [*rows, rows[5], rows[5], (None, None, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def hard_docs(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(hard_rows(), DOCS)
    return frame.select("*", *(F.lit("clash").alias(name) for name in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def small(spark):
    def table(name, scale="0.001"):
        return spark.read.parquet(f"/root/testdata/sf{scale}/{name}.parquet")

    return table


@pytest.fixture(scope="session")
def labels(small):
    return small("labels", "0.01")
