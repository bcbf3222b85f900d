"""Telemetry made from plain tables: envelopes as JSON (native) or wire bytes, and star messages.  Input of queries, tests and the bench."""

from __future__ import annotations

import io
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .sources import wire
from .sources.batches import bounded


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) * 1000


def text_attr(key: str, c: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(c.cast("string").alias("stringValue")).alias("value"))


def resource(service: Column, *more: Column) -> Column:
    return F.struct(F.array(text_attr("service.name", service), *more).alias("attributes"))


def scope(name: str, version: str = "1.0") -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(version).alias("version"))


def envelopes(records: DataFrame, signal: str, by: list[str], service: Column, scope_name: str, order: str, size: int = 500) -> DataFrame:
    """JSON payloads: one resource and scope each, about ``size`` records of column ``record``, grouped ``by``.

    Groups are cut by a hash of the order column, so no group grows with the input.
    """
    top, scopes, items = {"logs": ("resourceLogs", "scopeLogs", "logRecords"), "traces": ("resourceSpans", "scopeSpans", "spans"), "metrics": ("resourceMetrics", "scopeMetrics", "metrics")}[signal]
    cut = F.floor(F.col(order) / size).cast("bigint")
    made = records.groupBy(*by, cut.alias("_cut")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json("record").alias("r")))), lambda x: x["r"]).alias("_items"))
    head = F.to_json(F.struct(resource(service).alias("resource")))
    text = F.concat(F.lit(f'{{"{top}":['), F.substr(head, F.lit(1), F.length(head) - 1), F.lit(f',"{scopes}":[{{"scope":'), F.to_json(scope(scope_name)), F.lit(f',"{items}":['), F.array_join("_items", ","), F.lit("]}]}]}"))
    return made.select(F.xxhash64(*by, "_cut").alias("payload_id"), text.cast("binary").alias("payload"), F.lit("json").alias("format"))


def _parts(batch: pa.RecordBatch, size: int = 4 << 20):
    """A batch in parts of about so many bytes."""
    rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def as_format(payloads: DataFrame, signal: str, fmt: str) -> DataFrame:
    """The same payloads as ``protobuf`` or ``jsonl``."""
    if fmt == "jsonl":
        return payloads.select("payload_id", F.concat(F.lit(b"\n "), "payload", F.lit(b"\n\n")).alias("payload"), F.lit("jsonl").alias("format"))

    def run(batches):
        for b in batches:
            for part in _parts(b):
                data = [wire.write(signal, wire.read_json(signal, x.as_py())) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary()), pa.array([fmt] * len(data))], ["payload_id", "payload", "format"])

    return bounded(payloads).select("payload_id", "payload").mapInArrow(run, "payload_id bigint, payload binary, format string")


def write_bytes(trees: DataFrame, signal: str) -> DataFrame:
    """(payload_id, tree as JSON with ``NaN`` and ``Infinity`` allowed) to wire bytes; numbers keep their kind."""

    def run(batches):
        import json

        for b in batches:
            data = [wire.write(signal, json.loads(x.as_py())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["payload_id", "payload"])

    return trees.mapInArrow(run, "payload_id bigint, payload binary")


# star messages

_ATTR = pa.schema([("parent_id", pa.uint16()), ("key", pa.string()), ("type", pa.uint8()), ("str", pa.string()), ("int", pa.int64()), ("double", pa.float64()), ("bool", pa.bool_()), ("bytes", pa.binary()), ("ser", pa.binary())])
_KIND = {"stringValue": (1, "str"), "intValue": (2, "int"), "doubleValue": (3, "double"), "boolValue": (4, "bool"), "bytesValue": (7, "bytes"), "kvlistValue": (5, "ser"), "arrayValue": (6, "ser")}


def cbor(v: dict) -> bytes:
    """A value tree as CBOR: what nested star values are sent as."""

    def head(major: int, n: int) -> bytes:
        for low, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
            if n < 24 or n < 1 << 8 * size:
                return bytes([major << 5 | n]) if n < 24 else bytes([major << 5 | low]) + n.to_bytes(size, "big")
        raise ValueError(n)

    (name, x), *_ = [*v.items()] or [(None, None)]
    match name:
        case "stringValue":
            return head(3, len(x.encode())) + x.encode()
        case "bytesValue":
            return head(2, len(x)) + x
        case "intValue":
            return head(0, x) if x >= 0 else head(1, -1 - x)
        case "doubleValue":
            return b"\xfb" + struct.pack(">d", x)
        case "boolValue":
            return b"\xf5" if x else b"\xf4"
        case "arrayValue":
            items = x.get("values", [])
            return head(4, len(items)) + b"".join(cbor(i) for i in items)
        case "kvlistValue":
            items = x.get("values", [])
            return head(5, len(items)) + b"".join(cbor({"stringValue": i["key"]}) + cbor(i.get("value", {})) for i in items)
    return b"\xf6"


def _typed(v: dict) -> tuple:
    """A value as (type, column of its cell or None, what the cell holds)."""
    (name, x), *_ = [*v.items()] or [(None, None)]
    kind, field = _KIND.get(name, (0, None))
    return kind, field, cbor(v) if field == "ser" else x if field else None


def _differences(values: list) -> list:
    out, last = [], 0
    for v in values:
        out.append(None if v is None else v - last)
        last = last if v is None else v
    return out


def _batch(columns: dict[str, list], n: int, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of ``n`` rows; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([_array(columns.get(f.name), n, f.type) for f in schema], schema=schema)


def _array(values, n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind) if values is None else values if isinstance(values, pa.Array) else pa.array(values, kind)


def _struct(columns: dict[str, list], missing: list[bool], kind: pa.StructType) -> pa.Array:
    """Structs from columns; those ``missing`` are null."""
    return pa.StructArray.from_arrays([_array(columns.get(f.name), len(missing), f.type) for f in kind], fields=list(kind), mask=pa.array(missing) if any(missing) else None)


@lru_cache
def _empty(schema: pa.Schema) -> pa.RecordBatch:
    return _batch({}, 0, schema)


def _cells(values: list[tuple]) -> dict[str, list]:
    """Columns of typed cells (type, column or None, value)."""
    out = {"type": [v[0] for v in values]}
    for field in {v[1] for v in values if v[1]}:
        out[field] = [v[2] if v[1] == field else None for v in values]
    return out


_ATTR32 = _ATTR.set(0, pa.field("parent_id", pa.uint32()))


def attr_batch(owners: list[tuple[int, list]], bits: int = 16) -> pa.RecordBatch:
    """Attributes of (parent id, KeyValue trees), sorted so that equal values stand together, parents as differences."""
    schema = _ATTR if bits == 16 else _ATTR32
    rows = []  # in order of type, key, value and parent; the cells come last
    for parent, attrs in owners:
        for a in attrs:
            cell = _typed(a.get("value", {}))
            rows.append((cell[0], a["key"], str(cell[2]) if cell[0] in (1, 2, 3, 4) else "", parent, cell))
    if not rows:
        return _empty(schema)
    rows.sort(key=lambda r: r[:4])
    same = lambda a, b: a[0] not in (0, 5, 6) and a[:3] == b[:3] and (a[0] != 7 or a[4] == b[4])
    parents = [r[3] - rows[i - 1][3] if i and same(rows[i - 1], r) else r[3] for i, r in enumerate(rows)]
    return _batch({"parent_id": parents, "key": [r[1] for r in rows], **_cells([r[4] for r in rows])}, len(rows), schema)


class Writer:
    """IPC streams of one star stream: schemas go out once, later records continue them.  What was sent is not kept."""

    def __init__(self):
        self.open: dict = {}

    def payload(self, kind: int, batch: pa.RecordBatch) -> dict:
        if kind not in self.open:
            raw = io.BytesIO()
            self.open[kind] = (raw, pa.ipc.new_stream(raw, batch.schema))
        raw, writer = self.open[kind]
        writer.write_batch(batch)
        record = raw.getvalue()
        raw.seek(0)
        raw.truncate()
        return {"schema_id": f"s{kind}", "type": kind, "record": record}


def _contexts(tree: dict, top: str, scopes: str, items: str) -> tuple[list, list, list]:
    """Attributes by resource and by scope id, and the items with the cells of their context."""
    resources, attrs, out = [], [], []
    for r in tree[top]:
        for s in r[scopes]:
            given = s.get("scope", {})
            context = {"resource": {"id": len(resources)}, "scope": {"id": len(attrs), "name": given.get("name"), "version": given.get("version")}}
            attrs.append((len(attrs), given.get("attributes", [])))
            out += [(context, x) for x in s[items]]
        resources.append((len(resources), r.get("resource", {}).get("attributes", [])))
    return resources, attrs, out


def _root(contexts: list[dict], columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    """Root rows, their own ids and those of their contexts as differences."""
    n = len(contexts)
    if not n:
        return _empty(schema)
    there = [False] * n
    of = lambda part, cell: [c[part].get(cell) for c in contexts]
    resource = _struct({"id": _differences(of("resource", "id"))}, there, schema.field("resource").type)
    scope = _struct({"id": _differences(of("scope", "id")), "name": of("scope", "name"), "version": of("scope", "version")}, there, schema.field("scope").type)
    return _batch({"id": [0, *[1] * (n - 1)], "resource": resource, "scope": scope, **columns}, n, schema)


def _children(columns: dict[str, list], schema: pa.Schema, same: tuple[str, ...] | None) -> pa.RecordBatch:
    """Child rows, ids as differences; parents as differences to a previous row equal in ``same``, or to any (None)."""
    parents = columns["parent_id"]
    n = len(parents)
    if not n:
        return _empty(schema)
    equal = lambda i: i > 0 and (same is None or all(columns[c][i] == columns[c][i - 1] for c in same))
    sent = [p - parents[i - 1] if equal(i) else p for i, p in enumerate(parents)]
    return _batch({**columns, "parent_id": sent, "id": [0, *[1] * (n - 1)]}, n, schema)


_NS = pa.timestamp("ns")
_CONTEXT = [("resource", pa.struct([("id", pa.uint16())])), ("scope", pa.struct([("id", pa.uint16()), ("name", pa.string()), ("version", pa.string())]))]
_IDS = [("trace_id", pa.binary(16)), ("span_id", pa.binary(8))]


def _sent(writer: Writer, batches: dict[int, pa.RecordBatch]) -> list[dict]:
    """Payloads of the root (first) and of all tables with rows."""
    return [writer.payload(kind, b) for i, (kind, b) in enumerate(batches.items()) if i == 0 or b.num_rows]



_BODY = pa.struct([f for f in _ATTR if f.name not in ("parent_id", "key")])
_LOG_ROOT = pa.schema([("id", pa.uint16()), *_CONTEXT, ("time_unix_nano", _NS), ("observed_time_unix_nano", _NS), *_IDS, ("severity_number", pa.int32()), ("severity_text", pa.string()), ("event_name", pa.string()), ("body", _BODY), ("flags", pa.uint32()), ("dropped_attributes_count", pa.uint32())])


def _gather(items: list[dict], **fields) -> dict[str, list]:
    """Columns from the trees of rows: a JSON name, or (name, value where it is missing)."""
    return {c: [x.get(f) for x in items] if isinstance(f, str) else [x.get(*f) for x in items] for c, f in fields.items()}


def _ids(items: list[dict], **fields: str) -> dict[str, list]:
    return {c: [x.get(f) or None for x in items] for c, f in fields.items()}


def log_star(tree: dict, writer: Writer) -> list[dict]:
    """Payloads of one log request."""
    resources, scopes, items = _contexts(tree, "resourceLogs", "scopeLogs", "logRecords")
    logs = [x for _, x in items]
    bodies = [x.get("body") for x in logs]
    columns = _gather(logs, time_unix_nano="timeUnixNano", observed_time_unix_nano="observedTimeUnixNano", severity_number="severityNumber", severity_text="severityText", event_name="eventName", flags=("flags", 0), dropped_attributes_count=("droppedAttributesCount", 0)) | _ids(logs, trace_id="traceId", span_id="spanId")
    columns["body"] = _struct(_cells([(None, None, None) if b is None else _typed(b) for b in bodies]), [b is None for b in bodies], _BODY)
    payloads = {30: _root([c for c, _ in items], columns, _LOG_ROOT), 1: attr_batch(resources), 2: attr_batch(scopes), 31: attr_batch([(i, x.get("attributes", [])) for i, x in enumerate(logs)])}
    return [writer.payload(kind, b) for kind, b in payloads.items()]


_STATUS = pa.struct([("code", pa.int32()), ("status_message", pa.string())])
_SPAN_ROOT = pa.schema([("id", pa.uint16()), *_CONTEXT, ("start_time_unix_nano", _NS), ("duration_time_unix_nano", pa.duration("ns")), *_IDS, ("parent_span_id", pa.binary(8)), ("name", pa.string()), ("kind", pa.int32()), ("trace_state", pa.string()), ("flags", pa.uint32()), ("status", _STATUS)])


def _child(bits: int, *schema) -> pa.Schema:
    return pa.schema([("parent_id", pa.uint16() if bits == 16 else pa.uint32()), ("id", pa.uint32()), *schema])


_EVENT, _LINK = _child(16, ("name", pa.string()), ("time_unix_nano", _NS)), _child(16, *_IDS, ("trace_state", pa.string()))


def span_star(tree: dict, writer: Writer) -> list[dict]:
    """Payloads of one trace request."""
    resources, scopes, items = _contexts(tree, "resourceSpans", "scopeSpans", "spans")
    spans = [x for _, x in items]
    states = [x.get("status") for x in spans]
    columns = _gather(spans, start_time_unix_nano=("startTimeUnixNano", 0), trace_id="traceId", span_id="spanId", name=("name", ""), kind="kind", trace_state="traceState", flags=("flags", 0)) | _ids(spans, parent_span_id="parentSpanId")
    columns["duration_time_unix_nano"] = [max(x.get("endTimeUnixNano", 0) - start, 0) for x, start in zip(spans, columns["start_time_unix_nano"])]
    columns["status"] = _struct(_gather([x or {} for x in states], code=("code", 0), status_message="message"), [x is None for x in states], _STATUS)
    # rows of equal name (or trace) stand together, as senders sort them; within a span the order of equal ones stays
    side = lambda name, key: sorted(((i, c) for i, x in enumerate(spans) for c in x.get(name, ())), key=key)
    events, links = side("events", lambda e: e[1].get("name", "")), side("links", lambda e: e[1]["traceId"])
    rows = lambda found, **fields: {"parent_id": [p for p, _ in found], **_gather([c for _, c in found], **fields)}
    attrs = lambda found: [(i, c.get("attributes", [])) for i, (_, c) in enumerate(found)]
    return _sent(writer, {
        40: _root([c for c, _ in items], columns, _SPAN_ROOT), 1: attr_batch(resources), 2: attr_batch(scopes), 41: attr_batch([(i, x.get("attributes", [])) for i, x in enumerate(spans)]),
        42: _children(rows(events, name=("name", ""), time_unix_nano="timeUnixNano"), _EVENT, ("name",)), 43: _children(rows(links, trace_id="traceId", span_id="spanId", trace_state="traceState"), _LINK, ("trace_id",)),
        44: attr_batch(attrs(events), 32), 45: attr_batch(attrs(links), 32),
    })


_TIMES = [("start_time_unix_nano", _NS), ("time_unix_nano", _NS), ("flags", pa.uint32())]
_STATS = [("count", pa.uint64()), ("sum", pa.float64()), ("min", pa.float64()), ("max", pa.float64())]
_NUMBERS = [("int_value", pa.int64()), ("double_value", pa.float64())]
_BUCKETS = pa.struct([("bucket_counts", pa.list_(pa.uint64())), ("offset", pa.int32())])
_METRIC_ROOT = pa.schema([("id", pa.uint16()), *_CONTEXT, ("metric_type", pa.uint8()), ("name", pa.string()), ("description", pa.string()), ("unit", pa.string()), ("aggregation_temporality", pa.int32()), ("is_monotonic", pa.bool_())])
#: Payload types of points, of their attributes, exemplars and the exemplars' attributes, and the columns of the points.
_POINTS = {
    "number": (11, 15, 19, 22, _child(16, *_TIMES, *_NUMBERS)), "summary": (12, 16, None, None, _child(16, *_TIMES, *_STATS[:2])),
    "histogram": (13, 17, 20, 23, _child(16, *_TIMES, *_STATS, ("bucket_counts", pa.list_(pa.uint64())), ("explicit_bounds", pa.list_(pa.float64())))),
    "exp": (14, 18, 21, 24, _child(16, *_TIMES, *_STATS, ("scale", pa.int32()), ("zero_count", pa.uint64()), ("zero_threshold", pa.float64()), ("positive", _BUCKETS), ("negative", _BUCKETS))),
}
_POINT = {
    "time_unix_nano": "timeUnixNano", "start_time_unix_nano": "startTimeUnixNano", "flags": ("flags", 0), "int_value": "asInt", "double_value": "asDouble", "count": "count", "sum": "sum", "min": "min", "max": "max",
    "bucket_counts": "bucketCounts", "explicit_bounds": "explicitBounds", "scale": "scale", "zero_count": "zeroCount", "zero_threshold": "zeroThreshold",
}
_EXEMPLAR = _child(32, *_NUMBERS, ("time_unix_nano", _NS), *_IDS)


def _points(points: list[dict], schema: pa.Schema) -> dict[str, list]:
    """The columns of metric points that their table has."""
    out = _gather(points, **{c: f for c, f in _POINT.items() if c in schema.names})
    for side in ("positive", "negative"):
        if side in schema.names:
            found = [p.get(side) for p in points]
            out[side] = _struct(_gather([b or {} for b in found], offset=("offset", 0), bucket_counts=("bucketCounts", [])), [b is None for b in found], _BUCKETS)
    return out


def metric_star(tree: dict, writer: Writer) -> list[dict]:
    """Payloads of one metric request; gauges and sums share a table of points."""
    resources, scopes, items = _contexts(tree, "resourceMetrics", "scopeMetrics", "metrics")
    shapes = {"gauge": (1, "number"), "sum": (2, "number"), "histogram": (3, "histogram"), "exponentialHistogram": (4, "exp"), "summary": (5, "summary")}
    metrics, points = [x for _, x in items], {"number": [], "summary": [], "histogram": [], "exp": []}
    names = [next(s for s in shapes if s in x) for x in metrics]
    for i, (x, name) in enumerate(zip(metrics, names)):
        points[shapes[name][1]] += [(i, p) for p in x[name].get("dataPoints", [])]
    data = [x[name] for x, name in zip(metrics, names)]
    columns = {"metric_type": [shapes[name][0] for name in names], **_gather(metrics, name=("name", ""), description="description", unit="unit"), **_gather(data, aggregation_temporality="aggregationTemporality", is_monotonic="isMonotonic")}
    out = {10: _root([c for c, _ in items], columns, _METRIC_ROOT), 1: attr_batch(resources), 2: attr_batch(scopes)}
    for table, (kind, attr_kind, exemplar_kind, exemplar_attr_kind, schema) in _POINTS.items():
        if not points[table]:
            continue
        rows = [p for _, p in points[table]]
        out[kind] = _children({"parent_id": [m for m, _ in points[table]], **_points(rows, schema)}, schema, None)
        out[attr_kind] = attr_batch([(i, p.get("attributes", [])) for i, p in enumerate(rows)], 32)
        if exemplar_kind:
            found = sorted(((i, e) for i, p in enumerate(rows) for e in p.get("exemplars", [])), key=lambda x: (str(x[1].get("asInt")), str(x[1].get("asDouble"))))
            examples = [e for _, e in found]
            columns = {"parent_id": [p for p, _ in found], **_gather(examples, int_value="asInt", double_value="asDouble", time_unix_nano=("timeUnixNano", 0)), **_ids(examples, trace_id="traceId", span_id="spanId")}
            out[exemplar_kind] = _children(columns, _EXEMPLAR, ("int_value", "double_value"))
            out[exemplar_attr_kind] = attr_batch([(i, e.get("filteredAttributes", [])) for i, e in enumerate(examples)], 32)
    return _sent(writer, out)


MESSAGE = "stream_id string, batch_id bigint, payloads array<struct<schema_id:string,type:int,record:binary>>"


STARS = {"logs": log_star, "traces": span_star, "metrics": metric_star}


#: Bytes of records that are given out at once.
_GIVEN = 4 << 20


def star_messages(payloads: DataFrame, signal: str, streams: int = 8) -> DataFrame:
    """JSON payloads as star messages, dealt to some streams, each with one writer.

    A stream's payloads come to one task in order and are written one at a time, so
    a task holds neither its stream nor more than one stream's schemas.
    """
    schema = to_arrow_schema(T.StructType.fromDDL(MESSAGE))

    def run(batches):
        stream, writer, n, out, size = None, Writer(), 0, [], 0
        for b in batches:
            for s, data in zip(*b.columns):
                if s.as_py() != stream:
                    stream, writer, n = s.as_py(), Writer(), 0
                sent = STARS[signal](wire.read_json(signal, data.as_py()), writer)
                out.append({"stream_id": f"stream-{stream}", "batch_id": n, "payloads": sent})
                n, size = n + 1, size + sum(len(p["record"]) for p in sent)
                if size > _GIVEN or len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    dealt = bounded(payloads).select(F.pmod("payload_id", F.lit(streams)).cast("int").alias("stream"), "payload")
    return dealt.repartition("stream").sortWithinPartitions("stream", "payload").mapInArrow(run, MESSAGE)
