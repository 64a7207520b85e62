"""JSON payloads in a string column: strict parsing, extraction, contract check."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"

# Variant type names that JSON numbers get.
_NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL")
_REASONS = ("unparseable", "missing")


@contextmanager
def keep_last_key(spark: SparkSession) -> Iterator[None]:
    """Let frames built in this block keep the last value of a key that an object repeats.

    The parser takes the setting when a frame is built, so the caller's own
    setting is untouched afterwards. Without it such objects are unparseable.
    """
    before = spark.conf.get(_REPEATED_KEYS, None)
    spark.conf.set(_REPEATED_KEYS, "true")
    try:
        yield
    finally:
        spark.conf.unset(_REPEATED_KEYS) if before is None else spark.conf.set(_REPEATED_KEYS, before)


def strict_json(body: Column) -> Column:
    """`{"v": body}` as a variant, NULL unless `body` is exactly one JSON value.

    The variant parser stops after the first value and ignores what follows.
    Text that closes one kind of bracket early breaks the other, so parsing
    inside both an object and an array accepts whole values only. A flat object
    has its one closing brace at the end and cannot close anything early.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}")))
    in_array = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    flat = F.startswith(body, F.lit("{")) & (F.instr(body, "}") == F.length(body))
    return F.when(flat | in_array.isNotNull(), in_object)


def _path(field: str, root: str = "$.v") -> str:
    quote = "'" if '"' in field else '"'
    if quote in field:
        raise ValueError(f"a field name with both kinds of quotes has no path: {field}")
    return f"{root}[{quote}{field}{quote}]"


def json_field(body: Column, field: str, as_type: str) -> Column:
    """Top-level `field` as `as_type`; NULL for broken payloads and missing fields.

    Objects that repeat a key need `keep_last_key` or the session's setting.
    """
    return F.try_variant_get(strict_json(body), _path(field), as_type)


def parsed_body(doc: Column) -> Column:
    """The payload itself, as a variant, from what `strict_json` gives."""
    return F.try_variant_get(doc, "$.v", "variant")


def parsed_field(parsed: Column, field: str, as_type: str) -> Column:
    """Top-level `field` of a parsed payload as `as_type`; no text is parsed."""
    return F.try_variant_get(parsed, _path(field, "$"), as_type)


def contract_verdict(status: Column, body: Column, field: str) -> Column:
    """'pass' where status is 200 and `field` is a JSON number, else the reason.

    Payloads with the field are parsed once; the others again for the reason.
    """
    return parsed_verdict(status, strict_json(body), field)


def parsed_verdict(status: Column, doc: Column, field: str) -> Column:
    """`contract_verdict` from what `strict_json` gives."""
    kind = F.schema_of_variant(F.try_variant_get(doc, _path(field), "variant"))
    reason = F.when(doc.isNull(), "unparseable").otherwise("missing")
    name = F.substring_index(F.substring_index(F.coalesce(kind, reason), "(", 1), "<", 1)
    outcomes = {**dict.fromkeys(_NUMBERS, "pass"), **{r: r for r in _REASONS}}
    known = F.create_map(*(F.lit(text) for pair in outcomes.items() for text in pair))
    verdict = F.coalesce(F.element_at(known, name), F.lit("not_numeric"))
    return F.when(status == 200, verdict).otherwise("bad_status")
