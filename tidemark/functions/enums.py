"""Enum names, ids, numbers and content types, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import literal_map

#: Names of enum members, by number from 0.
SPAN_KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
STATUS_CODES = ("UNSET", "OK", "ERROR")
TEMPORALITIES = ("UNSPECIFIED", "DELTA", "CUMULATIVE")
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
#: Content types and their formats.
CONTENT_TYPES = {
    "application/x-ndjson": "jsonl",
    "application/jsonl": "jsonl",
    "application/json": "json",
    "application/otlp+json": "json",
    "application/x-protobuf": "protobuf",
    "application/protobuf": "protobuf",
    "application/otlp": "protobuf",
}
FORMAT_TYPES = {"jsonl": "application/x-ndjson", "json": "application/json", "protobuf": "application/x-protobuf", "auto": "application/x-protobuf"}


def _numbers(prefix: str, names) -> dict[str, int]:
    return {prefix + n: i for i, n in enumerate(names)}


#: Each severity has four steps, the first without a number.
ENUMS = {
    "kind": _numbers("SPAN_KIND_", SPAN_KINDS),
    "status": _numbers("STATUS_CODE_", STATUS_CODES),
    "temporality": _numbers("AGGREGATION_TEMPORALITY_", TEMPORALITIES),
    "severity": {"SEVERITY_NUMBER_UNSPECIFIED": 0} | {f"SEVERITY_NUMBER_{n}{k + 1 if k else ''}": 1 + 4 * i + k for i, n in enumerate(SEVERITIES) for k in range(4)},
}


def whole_number(c: Column) -> Column:
    """A JSON integer or a string of one; null if it is neither (Spark's own cast would accept spaces)."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))


def enum_number(c: Column, enum: str) -> Column:
    """Name or number to number; null if neither."""
    known = literal_map(tuple(ENUMS[enum].items()), "bigint")
    return F.coalesce(F.try_element_at(known, c), whole_number(c))


def bytes_of(c: Column) -> Column:
    """Hex first, then base64; null if neither."""
    return F.when(c == "", F.lit(b"")).when(c.rlike(r"^([0-9a-fA-F]{2})+$"), F.unhex(c)).when(c.rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.try_to_binary(c, F.lit("base64")))


def bytes_value(c: Column) -> Column:
    """As ``bytes_of``, and the text's own bytes if it is neither."""
    return F.coalesce(bytes_of(c), F.encode(c, "utf-8"))


def looks_like_json(payload: Column) -> Column:
    """The first byte that is not ASCII white space opens an object or a list."""
    return F.decode(payload, "iso-8859-1").rlike(r"^[ \t\n\f\r]*[\{\[]")


def format_of(content_type: Column) -> Column:
    known = literal_map(tuple(CONTENT_TYPES.items()))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(content_type))), F.lit("auto"))


def content_type_of(fmt: Column) -> Column:
    return F.try_element_at(literal_map(tuple(FORMAT_TYPES.items())), fmt)
