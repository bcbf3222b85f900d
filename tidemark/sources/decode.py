"""Payloads to intermediate rows.

``payloads`` has payload_id (bigint), payload (binary or string) and, if formats
differ, format (string: json, jsonl, protobuf or auto).

JSON and JSONL payloads, and those of format auto that are one line of JSON, are
read by one ``from_json`` a document with a fixed schema and exploded level by
level.  A payload with nested values, nulls, values of a wrong type or errors goes
through the readers in ``wire`` instead, in the same plan: an Arrow function gets
the payloads that need it (null for all others) and gives their rows, which join
the native ones in the first explode.  So what a payload gives does not depend on
the path, each payload is parsed once by ``from_json``, and nothing is a union.

Wire bytes have no reader in Spark: protobuf goes through ``mapInArrow``.

A payload with any error found by a reader yields one row whose ``error`` says why,
and no others.  With ``whole`` that holds for all errors: what only shows in a single
record (a time, an id, an enum) sends its payload to the readers before it is
exploded.  Without it such a record carries the error itself.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..functions import rows as finished
from ..functions.enums import bytes_of, bytes_value, enum_number, looks_like_json, whole_number
from ..schemas import ANY, ATTRS, BOOL, BYTES, DOUBLE, EMPTY, EXP_HISTOGRAM, GAUGE, HISTOGRAM, INT, IR, STR, SUM, SUMMARY, U64
from . import wire
from .batches import bounded

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string>"
_KV = f"array<struct<key:string,value:{_VALUE}>>"
_SCOPE = f"scope:struct<name:string,version:string,attributes:{_KV}>"
_RESOURCE = f"resource:struct<attributes:{_KV}>"
_EXEMPLARS = f"array<struct<timeUnixNano:string,asInt:string,asDouble:double,traceId:string,spanId:string,filteredAttributes:{_KV}>>"
_POINT = f"timeUnixNano:string,startTimeUnixNano:string,attributes:{_KV},flags:bigint,exemplars:{_EXEMPLARS}"
_BUCKETS = "struct<offset:int,bucketCounts:array<variant>>"
#: A point of any shape, so that all shapes of a metric are one array.
_POINTS = f"struct<dataPoints:array<struct<asInt:string,asDouble:double,count:variant,sum:double,min:double,max:double,bucketCounts:array<variant>,explicitBounds:array<double>,scale:int,zeroCount:variant,zeroThreshold:double,positive:{_BUCKETS},negative:{_BUCKETS},{_POINT}>>,aggregationTemporality:string,isMonotonic:boolean>"
JSON = {
    "logs": f"resourceLogs array<struct<{_RESOURCE},scopeLogs:array<struct<{_SCOPE},logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:string,severityText:string,body:{_VALUE},attributes:{_KV},traceId:string,spanId:string,eventName:string>>>>>>",
    "traces": f"resourceSpans array<struct<{_RESOURCE},scopeSpans:array<struct<{_SCOPE},spans:array<struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV},events:array<struct<timeUnixNano:string,name:string,attributes:{_KV}>>,links:array<struct<traceId:string,spanId:string,traceState:string,attributes:{_KV}>>,status:struct<code:string,message:string>,droppedAttributesCount:bigint,droppedEventsCount:bigint,droppedLinksCount:bigint,flags:bigint>>>>>>",
    "metrics": f"resourceMetrics array<struct<{_RESOURCE},scopeMetrics:array<struct<{_SCOPE},metrics:array<struct<name:string,description:string,unit:string,gauge:{_POINTS},sum:{_POINTS},histogram:{_POINTS},exponentialHistogram:{_POINTS},summary:{_POINTS}>>>>>>",
}
_TREE = {"logs": ("resourceLogs", "scopeLogs", "logRecords"), "traces": ("resourceSpans", "scopeSpans", "spans"), "metrics": ("resourceMetrics", "scopeMetrics", "metrics")}


def _any(v: Column) -> Column:
    number = whole_number(v["intValue"])
    kind = (
        F.when(v["stringValue"].isNotNull(), STR).when(v["intValue"].isNotNull(), F.when(number.isNotNull(), INT).otherwise(EMPTY)).when(v["doubleValue"].isNotNull(), DOUBLE)
        .when(v["boolValue"].isNotNull(), BOOL).when(v["bytesValue"].isNotNull(), BYTES).otherwise(EMPTY)
    )
    return F.when(v.isNotNull(), F.struct(kind.cast("tinyint").alias("kind"), v["stringValue"].alias("str"), number.alias("int"), v["doubleValue"].alias("dbl"), v["boolValue"].alias("bool"), F.when(v["bytesValue"].isNotNull(), bytes_value(v["bytesValue"])).alias("bytes"), F.lit(None).cast("string").alias("json"))).cast(ANY)


def _attributes(kv: Column) -> Column:
    return F.coalesce(F.transform(kv, lambda a: F.struct(a["key"].alias("key"), _any(a["value"]).alias("value"))), F.array()).cast(ATTRS)


def _time(c: Column) -> Column:
    """0 where it is missing, null where it is no time."""
    return F.when(c.isNull(), F.lit(0).cast("bigint")).when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("bigint"))


def _id(c: Column) -> Column:
    return F.when(c.isNotNull(), bytes_of(c))


def _enum(c: Column, enum: str) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(F.when(c == "", None).otherwise(enum_number(c, enum))).cast("int")


def _count(v: Column) -> Column:
    """Strings wrap as signed, numbers may fill 64 bits, anything else is 0."""
    text, kind = F.try_variant_get(v, "$", "string"), F.schema_of_variant(v)
    signed = whole_number(text)
    wrapped = F.when(signed < 0, signed.cast("decimal(21,0)") + F.lit(decimal.Decimal(1 << 64))).otherwise(signed.cast("decimal(21,0)"))
    number = F.try_variant_get(v, "$", "decimal(38,0)")
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")
    full = F.when(number < 0, number + F.lit(decimal.Decimal(1 << 64))).otherwise(number)
    return F.coalesce(F.when(kind == "STRING", wrapped).when(whole & (full < F.lit(decimal.Decimal(1 << 64))), full), F.lit(0)).cast(U64)


_KEYS = ["payload_id", "resource_ord", "scope_ord", "metric_ord", "record_ord", "resource_attrs", "scope_name", "scope_version", "scope_attrs"]


def _first(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(c, F.lit(text)) for c, text in checks), F.lit(None).cast("string"))


def _no_time(*times: Column) -> Column:
    return F.exists(F.array(*times), lambda x: x.isNotNull() & _time(x).isNull())


def _no_id(*ids: Column) -> Column:
    return F.exists(F.array(*ids), lambda x: x.isNotNull() & bytes_of(x).isNull())


def _no_enum(c: Column, enum: str) -> Column:
    return _enum(c, enum).isNull()


def _any_of(items: Column, check) -> Column:
    return F.coalesce(F.exists(items, check), F.lit(False))


def _exemplars_fail(x: Column) -> Column:
    return _any_of(x["exemplars"], lambda e: _no_time(e["timeUnixNano"]) | _no_id(e["traceId"], e["spanId"]))


#: What the readers refuse in a single record, by signal, and what a record is.
_REFUSED = {
    "logs": lambda x: _first((_no_time(x["timeUnixNano"], x["observedTimeUnixNano"]), "invalid timestamp"), (_no_id(x["traceId"], x["spanId"]), "invalid id"), (_no_enum(x["severityNumber"], "severity"), "invalid severity")),
    "traces": lambda x: _first(
        (_no_time(x["startTimeUnixNano"], x["endTimeUnixNano"]) | _any_of(x["events"], lambda e: _no_time(e["timeUnixNano"])), "invalid timestamp"),
        (_no_id(x["traceId"], x["spanId"], x["parentSpanId"]) | _any_of(x["links"], lambda e: _no_id(e["traceId"], e["spanId"])), "invalid id"),
        (_no_enum(x["kind"], "kind") | _no_enum(x["status"]["code"], "status"), "invalid enum"),
    ),
    "metrics": lambda p: _first((_no_time(p["timeUnixNano"], p["startTimeUnixNano"]) | _exemplars_fail(p), "invalid timestamp or id")),
}


def _of_width(c: Column, width: int) -> Column:
    return c.isNull() | F.octet_length(bytes_of(c)).isin(0, width)


def _needed(c: Column, width: int) -> Column:
    b = bytes_of(c)
    return F.coalesce((F.octet_length(b) == width) & (b != F.lit(bytes(width))), F.lit(False))


def _record_fails(signal: str):
    """Whether a record, or what hangs below it, is refused by the readers or by normalization."""
    refused = _REFUSED[signal]
    if signal == "logs":
        return lambda x: refused(x).isNotNull() | ~(_of_width(x["traceId"], 16) & _of_width(x["spanId"], 8))
    if signal == "traces":
        return lambda x: refused(x).isNotNull() | ~(_needed(x["traceId"], 16) & _needed(x["spanId"], 8))
    shapes = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")
    return lambda m: F.exists(F.array(*(_no_enum(m[k]["aggregationTemporality"], "temporality") | _any_of(m[k]["dataPoints"], lambda p: refused(p).isNotNull()) for k in shapes)), lambda x: x)


#: Rows of the readers that are held as Python objects, and bytes that are given out at once.
_HELD, _GIVEN = 2048, 4 << 20


def _lists(signal: str, batches, kind: pa.DataType):
    """Arrays of intermediate rows for arrays of payloads (null: not asked) and formats, in parts: so many rows at once, whatever an Arrow batch holds."""
    for payloads, formats in batches:
        out, parts, held, size = [], [], 0, 0
        for payload, fmt in zip(payloads, formats):
            rows = _read_rows(signal, payload.as_py(), fmt.as_py()) if payload.is_valid else None
            out.append(rows)
            held += len(rows or ())
            if held >= _HELD or len(out) >= _HELD:
                parts.append(pa.array(out, kind))
                size += parts[-1].nbytes
                out, held = [], 0
            if size >= _GIVEN:
                yield pa.concat_arrays(parts)
                parts, size = [], 0
        if out or parts or not len(payloads):
            yield pa.concat_arrays([*parts, pa.array(out, kind)])


def _fallback(signal: str):
    """Arrow function from payloads (null: not asked) and formats to arrays of intermediate rows without their payload_id."""
    struct = T.StructType(T.StructType.fromDDL(IR[signal]).fields[1:])
    kind = to_arrow_type(T.ArrayType(struct))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _lists(signal, batches, kind)

    return F.arrow_udf(run, T.ArrayType(struct))


def _native_rows(docs: DataFrame, signal: str) -> DataFrame:
    """Rows of ``docs`` (payload_id, docs: parsed documents or null, py: rows of the readers or null)."""
    top, scopes, items = _TREE[signal]
    kind = T.StructType.fromDDL(JSON[signal])[top].dataType
    one = T.ArrayType(T.StructType([T.StructField("r", kind.elementType), T.StructField("py", docs.schema["py"].dataType.elementType)]))
    given = F.flatten(F.transform("docs", lambda d: F.coalesce(d[top], F.array().cast(kind))))
    native = F.coalesce(F.transform(given, lambda r: F.struct(r.alias("r"), F.lit(None).cast(one.elementType["py"].dataType).alias("py"))), F.array()).cast(one)
    read = F.coalesce(F.transform("py", lambda y: F.struct(F.lit(None).cast(kind.elementType).alias("r"), y.alias("py"))), F.array()).cast(one)
    r = docs.select("payload_id", F.posexplode(F.concat(native, read)).alias("resource_ord", "e")).select("payload_id", "resource_ord", F.col("e.r").alias("r"), F.col("e.py").alias("py"))
    # rows of the readers are whole already: one empty element a level takes them along
    along = lambda c, t: F.when(F.col("py").isNotNull(), F.array(F.lit(None).cast(t.elementType))).otherwise(F.col(c))
    level = kind.elementType[scopes].dataType
    # attributes of a resource or scope are made before the rows below them are
    s = r.select("payload_id", "py", "resource_ord", _attributes(F.col("r.resource.attributes")).alias("resource_attrs"), F.posexplode(along(f"r.{scopes}", level)).alias("scope_ord", "s"))
    level = level.elementType[items].dataType
    x = s.select("payload_id", "py", "resource_ord", "scope_ord", "resource_attrs", F.col("s.scope.name").alias("scope_name"), F.col("s.scope.version").alias("scope_version"), _attributes(F.col("s.scope.attributes")).alias("scope_attrs"), F.posexplode(along(f"s.{items}", level)).alias("record_ord", "x"))
    made, x = {"logs": _logs, "traces": _spans, "metrics": _points}[signal](x, along)
    types = T.StructType.fromDDL(IR[signal])
    merged = [F.col("payload_id"), *(F.when(F.col("py").isNotNull(), F.col(f"py.{f.name}")).otherwise(made.get(f.name, F.col(f.name)).cast(f.dataType)).alias(f.name) for f in types.fields[1:])]
    return x.select(*merged)


def _logs(x: DataFrame, along) -> tuple[dict[str, Column], DataFrame]:
    c = lambda n: F.col(f"x.{n}")
    return {
        "metric_ord": F.lit(0), "time": _time(c("timeUnixNano")), "observed": _time(c("observedTimeUnixNano")), "trace_id": _id(c("traceId")), "span_id": _id(c("spanId")), "severity_number": _enum(c("severityNumber"), "severity"),
        "severity_text": c("severityText"), "event_name": c("eventName"), "body": _any(c("body")), "attrs": _attributes(c("attributes")), "dropped": F.lit(0), "flags": F.lit(0), "error": _REFUSED["logs"](F.col("x")),
    }, x


def _spans(x: DataFrame, along) -> tuple[dict[str, Column], DataFrame]:
    c = lambda n: F.col(f"x.{n}")
    events = F.coalesce(F.transform(c("events"), lambda e: F.struct(_time(e["timeUnixNano"]).alias("time"), F.coalesce(e["name"], F.lit("")).alias("name"), _attributes(e["attributes"]).alias("attrs"))), F.array())
    links = F.coalesce(F.transform(c("links"), lambda e: F.struct(_id(e["traceId"]).alias("trace_id"), _id(e["spanId"]).alias("span_id"), e["traceState"].alias("trace_state"), _attributes(e["attributes"]).alias("attrs"))), F.array())
    return {
        "metric_ord": F.lit(0), "start": _time(c("startTimeUnixNano")), "end": _time(c("endTimeUnixNano")), "trace_id": _id(c("traceId")), "span_id": _id(c("spanId")), "parent_span_id": _id(c("parentSpanId")),
        "trace_state": c("traceState"), "name": F.coalesce(c("name"), F.lit("")), "kind": _enum(c("kind"), "kind"), "status_code": _enum(c("status.code"), "status"), "status_message": c("status.message"),
        "attrs": _attributes(c("attributes")), "events": events, "links": links, **{b: F.coalesce(c(a), F.lit(0)) for a, b in (("droppedAttributesCount", "dropped_attributes"), ("droppedEventsCount", "dropped_events"), ("droppedLinksCount", "dropped_links"), ("flags", "flags"))},
        "error": _REFUSED["traces"](F.col("x")),
    }, x


def _points(x: DataFrame, along) -> tuple[dict[str, Column], DataFrame]:
    """All shapes of a metric are one array of points, the shape beside it."""
    m = lambda n: F.col(f"x.{n}")
    shapes = (("gauge", GAUGE), ("sum", SUM), ("histogram", HISTOGRAM), ("exponentialHistogram", EXP_HISTOGRAM), ("summary", SUMMARY))
    shape, data = F, F
    for name, number in shapes:
        there = m(name).isNotNull()
        shape, data = shape.when(there, number), data.when(there, m(name))
    x = x.withColumnRenamed("record_ord", "metric_ord").withColumns({"shape": shape, "data": data})
    kind = x.schema["data"].dataType["dataPoints"].dataType
    texts = [F.coalesce(m(n), F.lit("")).alias(n) for n in ("name", "description", "unit")]
    keys = [k for k in _KEYS if k != "record_ord"]
    p = x.select("py", *keys, "shape", *texts, _enum(F.col("data.aggregationTemporality"), "temporality").alias("temporality"), F.coalesce("data.isMonotonic", F.lit(False)).alias("monotonic"), F.posexplode(along("data.dataPoints", kind)).alias("record_ord", "p"))
    c = lambda n: F.col(f"p.{n}")
    of = lambda *shapes: F.col("shape").isin(*shapes)
    number, hist, exp, plain = of(GAUGE, SUM), of(HISTOGRAM, EXP_HISTOGRAM), of(EXP_HISTOGRAM), F.col("shape") != SUMMARY
    counts = lambda c: F.coalesce(F.transform(c, _count), F.array().cast(f"array<{U64}>"))
    exemplar = lambda e: F.struct(_time(e["timeUnixNano"]).alias("time"), _id(e["traceId"]).alias("trace_id"), _id(e["spanId"]).alias("span_id"), whole_number(e["asInt"]).alias("int_value"), F.when(e["asInt"].isNull(), e["asDouble"]).alias("double_value"), _attributes(e["filteredAttributes"]).alias("attrs"))
    types = {f.name: f.dataType for f in T.StructType.fromDDL(IR["metrics"])}
    buckets = lambda n, v: F.when(exp & c(n).isNotNull(), v)
    none = lambda k: F.array().cast(types[k])
    return {
        "time": F.when(plain, _time(c("timeUnixNano"))).otherwise(0), "start": F.when(plain, _time(c("startTimeUnixNano"))).otherwise(0),
        "int_value": F.when(number, whole_number(c("asInt"))), "double_value": F.when(number & c("asInt").isNull(), c("asDouble")),
        "count": F.when(hist, _count(c("count"))), **{k: F.when(hist, c(k)) for k in ("sum", "min", "max")},
        "bucket_counts": F.when(of(HISTOGRAM), counts(c("bucketCounts"))), "explicit_bounds": F.when(of(HISTOGRAM), F.coalesce(c("explicitBounds"), none("explicit_bounds"))),
        "scale": F.when(exp, F.coalesce(c("scale"), F.lit(0))), "zero_count": F.when(exp, _count(c("zeroCount"))), "zero_threshold": F.when(exp, F.coalesce(c("zeroThreshold"), F.lit(0.0))),
        "positive_offset": buckets("positive", F.coalesce(c("positive.offset"), F.lit(0))), "positive_counts": buckets("positive", counts(c("positive.bucketCounts"))),
        "negative_offset": buckets("negative", F.coalesce(c("negative.offset"), F.lit(0))), "negative_counts": buckets("negative", counts(c("negative.bucketCounts"))),
        "attrs": F.when(plain, _attributes(c("attributes"))).otherwise(none("attrs")), "flags": F.when(plain, F.coalesce(c("flags"), F.lit(0))).otherwise(0),
        "exemplars": F.when(plain, F.coalesce(F.transform(c("exemplars"), exemplar), F.array()).cast(types["exemplars"])).otherwise(none("exemplars")),
        "error": F.coalesce(F.when(F.col("temporality").isNull(), F.lit("invalid enum")), F.when(plain, _REFUSED["metrics"](F.col("p")))),
    }, p


#: Unsigned columns, and lists of them.
_WIDE, _WIDE_LISTS = ("count", "zero_count"), ("bucket_counts", "positive_counts", "negative_counts")


def _read_rows(signal: str, data: bytes | None, fmt: str) -> list[dict]:
    """Intermediate rows of a payload, or one row that says why there are none."""
    check = {"logs": finished.check_log, "traces": finished.check_span}.get(signal)
    try:
        rows = list(wire.ROWS[signal](wire.read_any(signal, data or b"", fmt)))
        for r in rows:
            if check:
                check(r)
            for k in _WIDE:
                if r.get(k) is not None:
                    r[k] = decimal.Decimal(r[k])
            for k in _WIDE_LISTS:
                if r.get(k) is not None:
                    r[k] = [decimal.Decimal(v) for v in r[k]]
        return rows
    except (wire.DecodeError, OverflowError) as e:
        return [{"error": str(e)}]


def _python_rows(payloads: DataFrame, signal: str) -> DataFrame:
    struct = T.StructType.fromDDL(IR[signal])
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            held = []
            for key, data, fmt in zip(*batch.columns):
                key = key.as_py()
                held += [{"payload_id": key, **r} for r in _read_rows(signal, data.as_py(), fmt.as_py())]
                if len(held) >= 2048:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return payloads.select("payload_id", F.col("payload").cast("binary"), "format").mapInArrow(run, struct)


#: Text fields; a value of another type in one of them is an error, which ``from_json`` would turn into text.
_TEXTS = "key|stringValue|bytesValue|severityText|eventName|name|version|description|unit|traceId|spanId|parentSpanId|traceState|message"
#: What the native path does not read as the Arrow path does.  A quote in a JSON string is escaped, so a
#: quoted name before a colon is a field's name, never part of a text.
_NOT_PLAIN = rf'"(?:arrayValue|kvlistValue)"\s*:|"(?:{_TEXTS})"\s*:\s*[^"\s]|(?<!\\)"\s*:\s*null|[\[,]\s*null\s*[,\]]'


def decode(payloads: DataFrame, signal: str, fmt: str | None = None, whole: bool = False) -> DataFrame:
    """Intermediate rows of all payloads; rows with ``error`` stand for payloads that failed."""
    if fmt is not None:
        payloads = payloads.withColumn("format", F.lit(fmt))
    elif "format" not in payloads.columns:
        payloads = payloads.withColumn("format", F.lit("auto"))
    payloads = bounded(payloads).select("payload_id", "payload", F.lower("format").alias("format"))
    if fmt == "protobuf":
        return _python_rows(payloads, signal)
    text, form = F.col("payload").cast("string"), F.col("format")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\r\x0b\x0c]"))
    one = (form == "json") | (form == "auto") & looks_like_json(F.col("payload").cast("binary")) & ~F.contains(text, F.lit("\n"))
    plain = ~text.rlike(_NOT_PLAIN) & text.rlike(r"\}\s*$")
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE", "allowNonNumericNumbers": "false"}
    schema = T.StructType.fromDDL(f"{JSON[signal]}, _bad string")
    read = F.transform(F.when(plain, F.when(one, F.array(text)).when(form == "jsonl", lines)), lambda x: F.from_json(x, schema, options))
    # a generator is not evaluated again by the filters and projections above it
    docs = payloads.select("payload_id", "payload", "format", F.explode(F.array(read)).alias("docs"))
    top, scopes, items = _TREE[signal]
    fine = (F.size("docs") > 0) & F.forall("docs", lambda d: d.isNotNull() & d["_bad"].isNull())
    if whole:
        fails = _record_fails(signal)
        fine = fine & ~_any_of(F.col("docs"), lambda d: _any_of(d[top], lambda r: _any_of(r[scopes], lambda s: _any_of(s[items], fails))))
    docs = docs.withColumn("_ok", F.coalesce(F.col("docs").isNotNull() & fine, F.lit(False)))
    asked = F.when(~F.col("_ok"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    docs = docs.select("payload_id", F.when(F.col("_ok"), F.col("docs")).alias("docs"), _fallback(signal)(asked, "format").alias("py"))
    return _native_rows(docs, signal)
