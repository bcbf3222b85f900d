"""The public transforms: payloads to tables.

``mode``: ``failfast`` raises at the first bad payload; ``permissive`` leaves bad
payloads out and lists them in ``errors``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..operators import normalize
from ..operators.partition import group_by_service
from ..sources.decode import decode

ORDINALS = normalize.ORDINALS
#: What a star message is told by; ``payload_id`` is its batch_id.
STAR_KEYS = ("stream_id", "payload_id")


class MetricTables:
    """Tables gauge, sum, histogram and exp_histogram, and the counts of skipped points; each plan is built when asked for."""

    NAMES = ("gauge", "sum", "histogram", "exp_histogram")

    def __init__(self, good: DataFrame, errors: DataFrame, keep: list[str]):
        self._good, self.errors, self._keep = good, errors, keep

    gauge = cached_property(lambda self: normalize.metrics(self._good, "gauge", self._keep))
    sum = cached_property(lambda self: normalize.metrics(self._good, "sum", self._keep))
    histogram = cached_property(lambda self: normalize.metrics(self._good, "histogram", self._keep))
    exp_histogram = cached_property(lambda self: normalize.metrics(self._good, "exp_histogram", self._keep))
    skipped = cached_property(lambda self: normalize.skipped(self._good))

    def tables(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in self.NAMES}


@dataclass
class Partitioned:
    rows: DataFrame
    groups: DataFrame


def _decoded(payloads: DataFrame, signal: str, fmt: str | None, mode: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and errors of payloads; permissive decoding knows a payload's error before its rows are made."""
    whole = mode == "permissive"
    return checked(decode(payloads, signal, fmt, whole), signal, mode, whole=whole)


def checked(ir: DataFrame, signal: str, mode: str, keys: tuple[str, ...] = ("payload_id",), whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows, and (keys, error) of bad payloads; ``whole``: a row with an error is its payload's only one, so nothing is joined."""
    if mode not in ("failfast", "permissive"):
        raise ValueError(f"unknown mode {mode!r}")
    if whole and mode == "permissive":
        return ir.where("error is null"), ir.where("error is not null").select(*keys, "error")
    ir = normalize.with_errors(ir, signal)
    errors = ir.where("error is not null").groupBy(*keys).agg(F.min("error").alias("error"))
    if mode == "failfast":
        fail = F.raise_error(F.concat(F.lit("payload "), F.concat_ws(":", *keys), F.lit(": "), F.col("error")))
        bad = F.col("error").isNotNull()
        if "shape" in ir.columns:  # what picks a table's points sees the error first, so any table fails with its payload
            return ir.withColumn("shape", F.when(bad, fail.cast("tinyint")).otherwise(F.col("shape"))), errors
        return ir.where(F.when(bad, fail.cast("boolean")).otherwise(F.lit(True))), errors
    return ir.where("error is null").join(errors.select(*keys), list(keys), "left_anti"), errors


def tables_of(ir: DataFrame, signal: str, mode: str = "failfast", keep: list = (), keys: tuple[str, ...] = ("payload_id",), whole: bool = False) -> tuple[dict[str, DataFrame], DataFrame, DataFrame | None]:
    """All tables of a signal's intermediate rows, its errors and, for metrics, the skipped points."""
    good, errors = checked(ir, signal, mode, keys, whole)
    if signal == "metrics":
        return {k: normalize.metrics(good, k, keep) for k in MetricTables.NAMES}, errors, normalize.skipped(good)
    return {signal: (normalize.logs if signal == "logs" else normalize.traces)(good, keep)}, errors, None


def transform_logs(payloads: DataFrame, fmt: str | None = None, mode: str = "failfast", keep_order: bool = False) -> DataFrame:
    """The logs table; ``keep_order`` adds the ordinals of input order."""
    good, _ = _decoded(payloads, "logs", fmt, mode)
    return normalize.logs(good, ORDINALS if keep_order else [])


def transform_traces(payloads: DataFrame, fmt: str | None = None, mode: str = "failfast", keep_order: bool = False) -> DataFrame:
    good, _ = _decoded(payloads, "traces", fmt, mode)
    return normalize.traces(good, ORDINALS if keep_order else [])


def metric_tables(ir: DataFrame, mode: str = "failfast", keep_order: bool = False, keys: tuple[str, ...] = ("payload_id",)) -> MetricTables:
    good, errors = checked(ir, "metrics", mode, keys)
    return MetricTables(good, errors, ORDINALS if keep_order else [])


def transform_metrics(payloads: DataFrame, fmt: str | None = None, mode: str = "failfast", keep_order: bool = False) -> MetricTables:
    """Four tables and the counts of skipped points, from one decode plan."""
    good, errors = _decoded(payloads, "metrics", fmt, mode)
    return MetricTables(good, errors, ORDINALS if keep_order else [])


def errors_of(payloads: DataFrame, signal: str, fmt: str | None = None) -> DataFrame:
    return _decoded(payloads, signal, fmt, "permissive")[1]


def transform_partitioned(payloads: DataFrame, signal: str, fmt: str | None = None, mode: str = "failfast") -> Partitioned | dict[str, Partitioned]:
    """Rows with their ordinals, and one row per service in first-seen order."""
    if signal == "metrics":
        m = transform_metrics(payloads, fmt, mode, True)
        return {k: Partitioned(t, group_by_service(t, ORDINALS)) for k, t in m.tables().items()}
    rows = (transform_logs if signal == "logs" else transform_traces)(payloads, fmt, mode, True)
    return Partitioned(rows, group_by_service(rows, ORDINALS))


def to_json_values(table: DataFrame) -> DataFrame:
    """One JSON object per row, binary as lower-case hex, null members left out."""
    from ..sources.sinks import ndjson

    return ndjson(table)


def view_of(spark, view: str, signal: str, fmt: str | None = None, name: str | None = None) -> str:
    """Register the table(s) made from a payload view as temp views, for ``spark.sql``."""
    payloads, name = spark.table(view), name or f"otlp_{signal}"
    if signal == "metrics":
        for k, t in transform_metrics(payloads, fmt).tables().items():
            t.createOrReplaceTempView(f"{name}_{k}")
    else:
        (transform_logs if signal == "logs" else transform_traces)(payloads, fmt).createOrReplaceTempView(name)
    return name


def transform_star(messages: DataFrame, signal: str, mode: str = "failfast", keep_order: bool = False) -> DataFrame | MetricTables:
    """The same tables from the columnar star protocol."""
    from ..sources.star_session import decode_rows

    ir = decode_rows(messages, signal)
    if mode == "failfast":
        fail = F.raise_error(F.concat(F.lit("stream "), F.col("stream_id"), F.lit(": "), F.col("error")))
        ir = ir.where(F.when(F.col("error").isNotNull(), fail.cast("boolean")).otherwise(F.lit(True)))
    else:
        ir = ir.where("error is null")
    if signal == "metrics":
        return metric_tables(ir, mode, keep_order, STAR_KEYS)
    good, _ = checked(ir, signal, mode, STAR_KEYS)
    return (normalize.logs if signal == "logs" else normalize.traces)(good, ORDINALS if keep_order else [])
