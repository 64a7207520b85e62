"""Contract gate, strictness of the parser, payload files."""

import json
import random

import pytest
from pyspark.sql import functions as F
from session_settings import settings

from spokeworks.functions import count_label, json_field, parsed_field
from spokeworks.operators import contract
from spokeworks.sources import read_payloads

# status, body, verdict
ROWS = [
    (200, '{"count": 5}', "pass"),
    (200, '{"count": 1.5}', "pass"),
    (200, '{"count": 1e400}', "pass"),
    (200, '{"count": 123456789012345678901234567890}', "pass"),
    (200, ' {"a": {"b": 1}, "count": -0} ', "pass"),
    (200, '{"count": "5"}', "not_numeric"),
    (200, '{"count": "missing"}', "not_numeric"),
    (200, '{"count": null}', "not_numeric"),
    (200, '{"count": true}', "not_numeric"),
    (200, '{"count": [1]}', "not_numeric"),
    (200, '{"count": {"count": 1}}', "not_numeric"),
    (200, "{}", "missing"),
    (200, '{"a": {"count": 1}}', "missing"),
    (200, "5", "missing"),
    (200, "null", "missing"),
    (200, "bad", "unparseable"),
    (200, "", "unparseable"),
    (200, None, "unparseable"),
    (200, '{"count": 5', "unparseable"),
    (200, '{"count": 5} x', "unparseable"),
    (200, '{"count": 5}{"count": 6}', "unparseable"),
    (200, '{"count": 5}, {"count": 6}', "unparseable"),
    (200, '{"count": 5}], [1', "unparseable"),
    (200, '{"count": 5}}, {"a": 1', "unparseable"),
    (200, '1}, {"count": 2}', "unparseable"),
    (200, '{"count": 05}', "unparseable"),
    (200, '{"count": NaN}', "unparseable"),
    (200, "{'count': 5}", "unparseable"),
    (500, '{"count": 5}', "bad_status"),
    (None, '{"count": 5}', "bad_status"),
]


@pytest.fixture(scope="module")
def checked(spark):
    table = spark.createDataFrame(ROWS, "status int, body string, expected string")
    return contract.check_payloads(table, "count")


def test_verdicts(checked):
    wrong = checked.filter(~F.col("verdict").eqNullSafe(F.col("expected"))).collect()
    assert not wrong


def _random_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 6:
        text = "s" + rng.choice(["", "}", "]", '"', "\\", "\n", "é", ","])
        return [None, True, rng.randint(-(10**6), 10**6), rng.random() * 1e9, text, 5][kind]
    if kind == 6:
        return [_random_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["count", "a", "b}"]): _random_value(rng, depth + 1) for _ in range(rng.randrange(3))}


def _damaged(rng, text):
    for _ in range(rng.randrange(4)):
        at, char = rng.randrange(len(text) + 1), rng.choice('{}[],:"0123456789.eE+-\\ tfn\n\t/x')
        text = text[:at] + rng.choice([char, "", ""]) + text[at + rng.randrange(2):]
    return text


def _strict_verdict(text):
    """What a strict parser says that keeps the last of repeated keys."""

    def constant(name):
        raise ValueError(name)

    try:
        value = json.loads(text, parse_constant=constant)
    except ValueError:
        return "unparseable"
    if not isinstance(value, dict) or "count" not in value:
        return "missing"
    return "pass" if type(value["count"]) in (int, float) else "not_numeric"


def test_damaged_payloads_get_the_verdict_of_a_strict_parser(spark):
    rng = random.Random(7)
    texts = [_damaged(rng, json.dumps(_random_value(rng), ensure_ascii=rng.random() < 0.5)) for _ in range(20_000)]
    rows = [(200, text, verdict) for text in texts if (verdict := _strict_verdict(text))]
    table = spark.createDataFrame(rows, "status int, body string, expected string")
    wrong = contract.check_payloads(table, "count").filter("verdict <> expected").collect()
    assert not wrong
    assert {r[2] for r in rows} == {"pass", "missing", "not_numeric", "unparseable"}


def test_split_keeps_every_row(checked, tmp_path, spark):
    good, bad = contract.passing(checked), contract.quarantined(checked)
    assert good.count() == 5 and good.count() + bad.count() == len(ROWS)
    contract.write_gated(checked, str(tmp_path / "gated"))
    back = spark.read.parquet(str(tmp_path / "gated"))
    counted = {r.verdict: r.payloads for r in contract.verdict_counts(checked).collect()}
    assert {r.verdict: r["count"] for r in back.groupBy("verdict").count().collect()} == counted


def test_repeated_keys_keep_the_last(spark):
    rows = [(200, '{"count": "x", "count": 5}'), (200, '{"a": 1, "a": 2, "count": 1}'), (200, '{"count": 5, "count": null}'), (200, '{"a": {"b": 1, "b": 2}, "count": 7}')]
    table = spark.createDataFrame(rows, "status int, body string")
    with settings(spark, spark__sql__variant__allowDuplicateKeys="false"):
        verdicts = contract.check_payloads(table, "count")
        values = contract.with_json_field(table, "count", "bigint")
        assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"
    assert [r.verdict for r in verdicts.collect()] == ["pass", "pass", "not_numeric", "pass"]
    assert [r["count"] for r in values.collect()] == [5, 1, None, 7]


def test_field_names_with_quotes(spark):
    table = spark.createDataFrame([('{"a\\"b": 1, "c\'d": 2}',)], "body string")
    assert table.select(json_field(F.col("body"), "c'd", "int")).first()[0] == 2
    with pytest.raises(ValueError, match="both kinds"):
        json_field(F.col("body"), "a'\"", "int")


def test_fields(spark):
    table = spark.createDataFrame([('{"quote": "hi \\"you\\""}',), ('{"quote": 1} x',), ("{}",)], "body string")
    quotes = [r[0] for r in table.select(json_field(F.col("body"), "quote", "string")).collect()]
    assert quotes == ['hi "you"', None, None]


def test_broken_lines_survive_reading(spark, tmp_path):
    (tmp_path / "payloads.jsonl").write_text('{"count": 1}\nbad\n{"count": "2"}\n')
    bodies = read_payloads(spark, str(tmp_path)).withColumn("status", F.lit(200))
    verdicts = sorted(r.verdict for r in contract.check_payloads(bodies, "count").collect())
    assert verdicts == ["not_numeric", "pass", "unparseable"]


def test_label(spark):
    table = spark.createDataFrame([(0,), (12,), (None,)], "n bigint")
    assert [r[0] for r in table.select(count_label(F.col("n"), "example.com")).collect()] == [
        "0 visitors to example.com",
        "12 visitors to example.com",
        "Loading visitor count...",
    ]


def test_stored_payloads_are_not_parsed_again(spark, tmp_path):
    table = spark.createDataFrame([(i, *row[:2]) for i, row in enumerate(ROWS)], "id int, status int, body string")
    path = str(tmp_path / "parsed")
    parsed = contract.parse_payloads(table, "count")
    # Once into an object, once into an array, for verdict and variant together.
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= contract.check_payloads(table, "count")._jdf.queryExecution().optimizedPlan().toString().count("parseJson")
    contract.write_parsed(parsed, path)
    back = spark.read.parquet(path)
    assert {r.id: r.verdict for r in back.collect()} == {i: row[2] for i, row in enumerate(ROWS)}
    fields = back.select("id", parsed_field(F.col("doc"), "count", "double").alias("count"))
    plan = fields._jdf.queryExecution().executedPlan().toString()
    assert "parse_json" not in plan.lower() and "parsejson" not in plan.lower() and "body" not in plan
    direct = contract.with_json_field(table, "count", "double").select("id", "count")
    assert fields.exceptAll(direct).isEmpty() and direct.exceptAll(fields).isEmpty()


def test_a_reader_of_one_field_reads_that_field(spark, tmp_path):
    """Frequent fields are columns of their own in the file."""
    table = spark.range(2000).select("id", F.lit(200).alias("status"), F.concat(F.lit('{"count": '), "id", F.lit(', "note": "some words"}')).alias("body"))
    contract.write_parsed(contract.parse_payloads(table, "count"), str(tmp_path / "p"))
    field = parsed_field(F.col("doc"), "count", "bigint")
    read = spark.read.parquet(str(tmp_path / "p")).select("id", field.alias("n"))
    assert read.filter("n <> id or n is null").isEmpty()
    import pyarrow.parquet as pq

    file = next((tmp_path / "p").glob("*.parquet"))
    assert any("typed_value.count.typed_value" in pq.ParquetFile(file).schema.column(i).path for i in range(len(pq.ParquetFile(file).schema.names)))
