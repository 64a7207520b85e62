"""Tolerant number parsing and exact one-decimal rounding, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space skipped before a number: ASCII, Unicode separators, byte-order mark.
_SPACE = r"^[\s\x0B\p{Z}\x{FEFF}]*"
_INT = _SPACE + r"([+-]?[0-9]+)"
_FLOAT = _SPACE + r"([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"

# Fractions count in units of 2^-57: exact for every double from 1/32 up to 1.
_UNIT_BITS = 57
# Whole parts up to here keep ten times the value inside a bigint.
_WHOLE_LIMIT = 9.0e17
# From here on the rounded text is the number's own, with an exponent.
_EXPONENT_FROM = 1.0e21
# Tenths up to here are whole doubles.
_EXACT_TENTHS = 1 << 53


def _leading_number(col: Column, plain: str, pattern: str, default: str) -> Column:
    """Cast texts made of `plain` characters only; search the others for `pattern`."""
    text = F.when(F.length(col) > 0, col).otherwise(F.lit(default))
    cast = F.when(F.ltrim(text, F.lit(plain)) == "", text.try_cast("double"))
    return F.coalesce(cast, F.regexp_extract(text, pattern, 1).try_cast("double"))


def parse_int(col: Column, default: str = "0") -> Column:
    """Longest leading decimal integer as a double; NULL where there is none.

    NULL and '' take `default` first. Doubles hold any integer the input can
    spell, so nothing overflows.
    """
    return _leading_number(col, "0123456789", _INT, default)


def parse_float(col: Column, default: str = "0") -> Column:
    """Longest leading decimal number as a double; NULL where there is none."""
    return _leading_number(col, "0123456789.", _FLOAT, default)


def parse_flag(col: Column) -> Column:
    """True only for the exact text 'true'."""
    return F.coalesce(col == "true", F.lit(False))


def fixed1_tenths(x: Column) -> Column:
    """`x` rounded to one decimal, in integer tenths, ties away from zero.

    Rounds the exact binary value, which `round` and `format_string` do not:
    they start from the shortest decimal text. The fraction becomes an integer
    count of 2^-57, and the rest is integer arithmetic; fractions below 1/32
    may lose bits there, but round to zero anyway. NULL for NULL and NaN, and
    where tenths exceed a bigint (9e17 and more); `fixed1_text` and
    `fixed1_value` go on there. `x` appears several times in the result, so give
    it a column of its own when it is costly.
    """
    size = F.abs(x)
    whole = F.floor(size)
    units = ((size - whole) * float(1 << _UNIT_BITS)).cast("bigint")
    fraction = F.shiftright(units * 10 + F.lit(1 << (_UNIT_BITS - 1)), _UNIT_BITS)
    tenths = whole * 10 + fraction
    return F.when(size < _WHOLE_LIMIT, F.when(x < 0, -tenths).otherwise(tenths))


def tenths_text(tenths: Column, negative: Column | None = None) -> Column:
    """Integer tenths as text with exactly one decimal."""
    size = F.abs(tenths)
    sign = F.when(tenths < 0 if negative is None else negative, "-").otherwise("")
    whole = F.call_function("div", size, F.lit(10))
    return F.concat(sign, whole.cast("string"), F.lit("."), (size % 10).cast("string"))


def _large_text(x: Column) -> Column:
    """Text of what has no bigint tenths: whole doubles digit by digit, then exponents and infinities."""
    size = F.abs(x)
    # A double splits exactly into a multiple of 2^32 and a rest.
    high = F.floor(size / float(1 << 32))
    low = (size - high * float(1 << 32)).cast("bigint").cast("decimal(20,0)")
    whole = high.cast("bigint").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low
    # JavaScript writes 1e+21 where Java has 1.0E21.
    exponent = F.replace(F.replace(size.cast("string"), F.lit(".0E"), F.lit("E")), F.lit("E"), F.lit("e+"))
    text = (
        F.when(size == float("inf"), "Infinity")
        .when(size >= _EXPONENT_FROM, exponent)
        .otherwise(F.concat(whole.cast("string"), F.lit(".0")))
    )
    return F.concat(F.when(x < 0, "-").otherwise(""), text)


def fixed1_text(x: Column) -> Column:
    """`x` as text with exactly one decimal; small negatives print '-0.0'.

    All finite numbers below 1e21 print in full, larger ones with an exponent,
    infinities as 'Infinity'; NULL for NULL and NaN.
    """
    small = tenths_text(fixed1_tenths(x), negative=x < 0)
    return F.when(F.isnan(x), F.lit(None)).when(F.abs(x) < _WHOLE_LIMIT, small).otherwise(_large_text(x))


def fixed1_value(x: Column) -> Column:
    """The number that `fixed1_text` spells, as a double."""
    tenths = fixed1_tenths(x)
    # Beyond, doubles are an eighth apart or more, and adding the tenth rounds as its text would.
    apart = F.call_function("div", tenths, F.lit(10)) + (tenths % 10) / F.lit(10.0)
    exact = F.when(F.abs(tenths) < _EXACT_TENTHS, tenths / F.lit(10.0)).otherwise(apart)
    # Numbers from 2^53 on are whole.
    return F.when(F.isnan(x), F.lit(None)).when(F.abs(x) >= float(_EXACT_TENTHS), x).otherwise(exact)
