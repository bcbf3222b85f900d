"""Transforms as SQL table functions, for lateral joins over a column of payloads.

    register(spark)
    SELECT p.id, l.* FROM payloads p, LATERAL otlp_logs(p.payload, 'json') l
    SELECT ... FROM payloads p, LATERAL otlp(p.payload, p.format, 'sum', 'permissive') m

``otlp_logs``, ``otlp_traces``, ``otlp_gauge``, ``otlp_sum``, ``otlp_histogram`` and
``otlp_exp_histogram`` have their table's columns; ``otlp`` takes the table's name
as its third argument, a constant, from which its columns follow.  ``otlp_skipped``
gives one row of counts of the points that are in no table and ``otlp_error`` one
row for a payload that cannot be read, none for one that can.

Arguments: payload (binary or string; null gives no rows), format (json, jsonl,
protobuf or auto; auto if it is left out or null) and mode: ``failfast`` raises
at a bad payload, ``permissive`` gives no rows for it.  A payload is read by one
call, in the task that holds it: no exchange, results in Arrow batches.  Spark
runs ``LEFT JOIN LATERAL`` with a Python table function as an inner join, so a
payload without rows has none there either.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession, types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import rows
from ..schemas import EXP_HISTOGRAM, GAUGE, HISTOGRAM, SUM, TABLES
from ..sources import wire

SHAPES = {"gauge": GAUGE, "sum": SUM, "histogram": HISTOGRAM, "exp_histogram": EXP_HISTOGRAM}
SIGNALS = {"logs": "logs", "traces": "traces"} | dict.fromkeys(SHAPES, "metrics")
MODES = ("failfast", "permissive")
FORMATS = ("json", "jsonl", "protobuf", "auto")
SKIPPED = ("summaries", "nan_values", "infinity_values", "missing_values")


def _struct(ddl: str) -> T.StructType:
    """The columns of a table; all may be null to SQL, for Spark does not check what Python returns."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in T.StructType.fromDDL(ddl)])




def read(signal: str, payload: bytes | str, fmt: str | None) -> list[dict]:
    data = payload.encode() if isinstance(payload, str) else bytes(payload)
    try:
        return list(wire.ROWS[signal](wire.read_any(signal, data, (fmt or "auto").lower())))
    except OverflowError as e:
        raise wire.DecodeError(str(e)) from e


def table_rows(table: str, payload: bytes | str | None, fmt: str | None) -> list[tuple]:
    """Finished rows of one payload; a payload with any error has none."""
    if payload is None:
        return []
    ir = read(SIGNALS[table], payload, fmt)
    if table not in SHAPES:
        return [tuple((rows.logs if table == "logs" else rows.traces)(r)) for r in ir]
    return [tuple(rows.point(r)) for r in ir if r["shape"] == SHAPES[table] and rows.skip_reason(r) is None]


def _argument(arg: AnalyzeArgument, name: str, kinds: tuple, constants: tuple = ()) -> None:
    if not isinstance(arg.dataType, (T.NullType, *kinds)):
        raise TypeError(f"{name} must be {' or '.join(k.typeName() for k in kinds)}, not {arg.dataType.simpleString()}")
    if constants and arg.isConstantExpression and arg.value is not None and str(arg.value).lower() not in constants:
        raise ValueError(f"{name} must be one of {', '.join(constants)}, not {arg.value!r}")


def _check(payload: AnalyzeArgument, format: AnalyzeArgument | None, mode: AnalyzeArgument | None) -> None:
    _argument(payload, "payload", (T.BinaryType, T.StringType))
    if format is not None:
        _argument(format, "format", (T.StringType,), FORMATS)
    if mode is not None:
        _argument(mode, "mode", (T.StringType,), MODES)


class _Base:
    def _rows(self, table: str, payload, format, mode) -> Iterator[tuple]:
        mode = (mode or "failfast").lower()
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        try:
            yield from table_rows(table, payload, format)
        except wire.DecodeError:
            if mode == "failfast":
                raise


def _function(table: str, columns: T.StructType):
    class Function(_Base):
        @staticmethod
        def analyze(payload: AnalyzeArgument, format: AnalyzeArgument | None = None, mode: AnalyzeArgument | None = None) -> AnalyzeResult:
            _check(payload, format, mode)
            return AnalyzeResult(schema=columns)

        def eval(self, payload, format=None, mode="failfast") -> Iterator[tuple]:
            yield from self._rows(table, payload, format, mode)

    return Function


def _any_table(columns: dict[str, T.StructType]):
    class Function(_Base):
        @staticmethod
        def analyze(payload: AnalyzeArgument, format: AnalyzeArgument, table: AnalyzeArgument, mode: AnalyzeArgument | None = None) -> AnalyzeResult:
            _check(payload, format, mode)
            if not table.isConstantExpression or table.value not in columns:
                raise ValueError(f"table must be a constant, one of {', '.join(columns)}")
            return AnalyzeResult(schema=columns[table.value])

        def eval(self, payload, format, table, mode="failfast") -> Iterator[tuple]:
            yield from self._rows(table, payload, format, mode)

    return Function


def _skipped(columns: T.StructType):
    class Function(_Base):
        @staticmethod
        def analyze(payload: AnalyzeArgument, format: AnalyzeArgument | None = None) -> AnalyzeResult:
            _check(payload, format, None)
            return AnalyzeResult(schema=columns)

        def eval(self, payload, format=None) -> Iterator[tuple]:
            if payload is not None:
                found = [rows.skip_reason(r) for r in read("metrics", payload, format)]
                counts = [found.count(x) for x in SKIPPED]
                yield (*counts, sum(counts))

    return Function


def _error(columns: T.StructType):
    class Function(_Base):
        @staticmethod
        def analyze(payload: AnalyzeArgument, format: AnalyzeArgument, signal: AnalyzeArgument) -> AnalyzeResult:
            _check(payload, format, None)
            _argument(signal, "signal", (T.StringType,), tuple(wire.ROWS))
            return AnalyzeResult(schema=columns)

        def eval(self, payload, format, signal) -> Iterator[tuple]:
            try:
                if payload is not None:
                    for r in read(signal, payload, format):
                        {"logs": rows.logs, "traces": rows.traces}.get(signal, lambda r: None)(r)
            except wire.DecodeError as e:
                yield (str(e),)

    return Function


def register(spark: SparkSession, prefix: str = "otlp") -> list[str]:
    """Register all functions in the session; their names."""
    columns = {k: _struct(ddl) for k, ddl in TABLES.items()}
    made = {f"{prefix}_{k}": _function(k, c) for k, c in columns.items()}
    made[prefix] = _any_table(columns)
    made[f"{prefix}_skipped"] = _skipped(_struct(", ".join(f"{x} long" for x in (*SKIPPED, "total"))))
    made[f"{prefix}_error"] = _error(_struct("error string"))
    for name, handler in made.items():
        spark.udtf.register(name, udtf(handler, useArrow=True))
    return list(made)
