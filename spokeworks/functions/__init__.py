from spokeworks.functions.numbers import (
    fixed1_tenths,
    fixed1_text,
    fixed1_value,
    parse_flag,
    parse_float,
    parse_int,
    tenths_text,
)
from spokeworks.functions.payload import (
    contract_verdict,
    json_field,
    keep_last_key,
    parsed_body,
    parsed_field,
    parsed_verdict,
    strict_json,
)
from spokeworks.functions.text import count_label, iso_instant, utc_instant, with_iso_instant, xml_escape
from spokeworks.functions.urls import (
    file_extension,
    object_key,
    trailing_slash,
    url_host,
    url_path,
    url_query,
)

__all__ = [
    "parsed_verdict",
    "parsed_field",
    "parsed_body",
    "contract_verdict",
    "count_label",
    "file_extension",
    "fixed1_tenths",
    "fixed1_text",
    "fixed1_value",
    "iso_instant",
    "json_field",
    "keep_last_key",
    "object_key",
    "parse_flag",
    "parse_float",
    "parse_int",
    "strict_json",
    "tenths_text",
    "trailing_slash",
    "url_host",
    "url_path",
    "url_query",
    "utc_instant",
    "with_iso_instant",
    "xml_escape",
]
