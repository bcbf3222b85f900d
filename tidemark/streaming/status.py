"""Status codes of acknowledgements, and the code and words of each outcome of a message."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Status codes of the columnar protocol (a part of the usual RPC codes).
CODES = {"OK": 0, "CANCELED": 1, "INVALID_ARGUMENT": 3, "DEADLINE_EXCEEDED": 4, "PERMISSION_DENIED": 7, "RESOURCE_EXHAUSTED": 8, "ABORTED": 10, "INTERNAL": 13, "UNAVAILABLE": 14, "UNAUTHENTICATED": 16}
#: What a message is answered, by outcome.
OUTCOMES = {"ok": (0, ""), "full": (8, "ingest buffer full"), "invalid": (3, "invalid payload"), "internal": (13, "ingest error"), "unauthenticated": (16, "unauthorized")}


def code(outcome: str) -> int:
    return OUTCOMES[outcome][0]


def words(outcome: str) -> str:
    return OUTCOMES[outcome][1]


def name_of(status: Column) -> Column:
    """Name of a code; null for a number that is none."""
    return F.try_element_at(F.create_map(*(x for k, v in CODES.items() for x in (F.lit(v), F.lit(k)))), status.cast("int"))


def after_failure(acks):
    """Acknowledgements of a batch that could not be written: what would have been fine is an internal error."""
    fine = F.col("status_code") == code("ok")
    return acks.withColumns({"status_code": F.when(fine, code("internal")).otherwise(F.col("status_code")).cast("int"), "message": F.when(fine, words("internal")).otherwise(F.col("message"))})
