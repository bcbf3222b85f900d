"""Text of numbers and strings inside JSON, as Column expressions."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

from pyspark import SparkContext
from pyspark.sql import Column, functions as F


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, so that the expression doesn't grow with each use of it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shortest(c: Column) -> Column:
    """Text of |c| with as few digits as read back: the JVM's may have one or two too many where it has 16 or more, or is subnormal."""
    size = F.abs(c)
    s = size.cast("string")
    digits = F.length(F.regexp_replace(F.split_part(s, F.lit("E"), F.lit(1)), r"^0\.0*|\.", ""))
    with_digits = lambda n: F.replace(F.upper(F.call_function("format_string", F.concat(F.lit("%."), F.greatest(n - 1, F.lit(0)).cast("string"), F.lit("e")), size)), F.lit("+"), F.lit(""))
    reads_back = lambda t: t.cast("double") == size
    fewest = F.coalesce(F.get(F.filter(F.transform(F.array(digits - 2, digits - 1), with_digits), reads_back), F.lit(0)), s)
    return F.when((F.length(s) > 16) | (size < 2.3e-308), fewest).otherwise(s)


def _common(c: Column) -> Column:
    """Whether the JVM's text has no exponent and no digit too many, as most numbers have it: it is then taken as it is."""
    s = c.cast("string")
    return (F.length(s) <= 16) & ~F.contains(s, F.lit("E"))


def _parts(s: Column) -> Column:
    """Of the JVM's text of a positive double: its significant ``digits`` and the place of its ``point`` counted from their start."""
    mantissa = F.regexp_extract(s, r"^([0-9.]+)", 1)
    whole, fraction = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    power = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(s, r"E(-?[0-9]+)$", 1), F.lit("")), F.lit("S999")).cast("int"), F.lit(0))
    lead = F.when(whole == "0", -F.length(F.regexp_extract(fraction, r"^(0*)", 1))).otherwise(F.length(whole))
    digits = F.regexp_replace(F.regexp_replace(F.concat(whole, fraction), r"^0+", ""), r"0+$", "")
    return F.struct(digits.alias("digits"), (lead + power).alias("point"))


def _plain(digits: Column, point: Column, tail: str) -> Column:
    whole = F.concat(F.rpad(digits, point, "0"), F.lit(tail))
    return F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)).when(F.length(digits) <= point, whole).otherwise(
        F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1))
    )


def _rare(c: Column, body) -> Column:
    """Sign, and ``body`` of the digits and the point of a number that is not 0."""
    text = _let(_shortest(c), lambda s: _let(_parts(s), lambda p: body(p["digits"], p["point"])))
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), text)


def json_double(c: Column) -> Column:
    """Shortest text that reads back; ``1.0``, ``1e16``, ``1.5e-7``.  For finite values."""

    def text(digits: Column, point: Column) -> Column:
        first, rest = F.substr(digits, F.lit(1), F.lit(1)), F.substr(digits, F.lit(2))
        science = F.concat(first, F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("."), rest)), F.lit("e"), (point - 1).cast("string"))
        return F.when((point > -5) & (point <= 16), _plain(digits, point, ".0")).otherwise(science)

    return F.when(_common(c), c.cast("string")).otherwise(_rare(c, text))


def display_double(c: Column) -> Column:
    """As ``json_double`` but never with an exponent, and without ``.0``."""
    s = c.cast("string")
    short = F.when(F.endswith(s, F.lit(".0")), F.left(s, F.length(s) - 2)).otherwise(s)
    return F.when(_common(c), short).otherwise(_rare(c, lambda digits, point: _plain(digits, point, "")))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


@lru_cache(maxsize=64)
def _made(items: tuple, gateway: int, kind: str | None) -> Column:
    lit = lambda v: F.lit(v).cast(kind) if kind else F.lit(v)
    return F.create_map(*chain.from_iterable((F.lit(k), lit(v)) for k, v in items))


def literal_map(items: tuple, kind: str | None = None) -> Column:
    """A constant map, made once per JVM: each literal is a call to it."""
    return _made(items, id(SparkContext._gateway), kind)


#: JSON's short escapes.
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quote(c: Column) -> Column:
    """A JSON string; escapes only what JSON must have escaped."""
    codes = {chr(i): f"\\u{i:04x}" for i in range(32)} | _SHORT
    known = literal_map(tuple(codes.items()))
    escaped = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(known, x), x)), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(c), F.lit('"'))


def lossy(c: Column) -> Column:
    """Bytes as text; invalid sequences become U+FFFD."""
    return F.make_valid_utf8(c.cast("string"))


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)
