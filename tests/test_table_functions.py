"""SQL table functions: the same rows as the DataFrame transforms, arguments, modes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark import queries as q, synth
from tidemark.plans import table_functions as tf, transform as t
from tidemark.sources import wire

from .test_engine import attr, log, payloads, views  # noqa: F401


@pytest.fixture(scope="module")
def named(spark):
    return tf.register(spark)


def _rows(df):
    """All rows, in an order that their text gives."""
    key = lambda r: tuple(str(bytes(v) if isinstance(v, bytearray) else v) for v in r)
    return sorted(map(key, df.collect()))


def _table(made, table):
    return made if table in ("logs", "traces") else getattr(made, table)


@pytest.mark.parametrize(("table", "made", "signal"), [("logs", "log_payloads", "logs"), ("gauge", "gauge_payloads", "metrics"), ("histogram", "histogram_payloads", "metrics"), ("exp_histogram", "exp_histogram_payloads", "metrics"), ("traces", "child_payloads", "traces")])
@pytest.mark.parametrize("fmt", ["json", "protobuf"])
def test_same_rows_as_the_transform(spark, sf, named, table, made, signal, fmt):
    p = getattr(q, made)(spark, sf)
    p = p if fmt == "json" else synth.as_format(p, signal, fmt)
    p.createOrReplaceTempView("given")
    want = _table(getattr(t, f"transform_{signal}")(p, fmt), table)
    got = spark.sql(f"SELECT l.* FROM given p, LATERAL otlp_{table}(p.payload, '{fmt}') l")
    assert got.columns == want.columns and [x[1] for x in got.dtypes] == [x[1] for x in want.dtypes]
    assert _rows(got) == _rows(want)
    if table not in ("logs", "traces"):
        assert _rows(spark.sql(f"SELECT l.* FROM given p, LATERAL otlp(p.payload, p.format, '{table}') l" if "format" in p.columns else f"SELECT l.* FROM given p, LATERAL otlp(p.payload, '{fmt}', '{table}') l")) == _rows(want)


def _odd_value(r, depth=0):
    kinds = ["stringValue", "intValue", "doubleValue", "boolValue", "bytesValue", "none"] + (["arrayValue", "kvlistValue"] if depth < 3 else [])
    k = r.choice(kinds)
    made = {
        "stringValue": lambda: r.choice(["", "x", "é\"\\\n\x01", "日本", "unknown"]), "intValue": lambda: r.choice([0, -5, 1 << 62]), "boolValue": lambda: r.random() < 0.5, "bytesValue": lambda: r.choice([b"", b"hi", b"\xff\xfeq"]),
        "doubleValue": lambda: r.choice([0.0, -0.0, 3.0, 1e20, 1.5e-7, 0.1, math.nan, math.inf, r.uniform(-1e6, 1e6)]), "arrayValue": lambda: {"values": [_odd_value(r, depth + 1) for _ in range(r.randint(0, 3))]},
        "kvlistValue": lambda: {"values": _odd_attrs(r, depth + 1)}, "none": lambda: None,
    }[k]()
    return {} if k == "none" else {k: made}


def _odd_attrs(r, depth=0):
    keys = ["service.name", "service.namespace", "a", "b", "é", "B"]
    return [{"key": r.choice(keys), "value": _odd_value(r, depth)} if r.random() < 0.9 else {"key": r.choice(keys)} for _ in range(r.randint(0, 6))]


def _odd_requests(seed):
    r = random.Random(seed)
    ids = lambda n: r.choice([b"", bytes(n), bytes(range(1, n + 1))])
    for _ in range(40):
        records = [{"timeUnixNano": r.choice([0, 5, (1 << 63) - 1]), "traceId": ids(16), "spanId": ids(8), "body": _odd_value(r), "attributes": _odd_attrs(r), "severityNumber": r.randint(0, 30), "eventName": r.choice(["", "e"]), "flags": 3, "droppedAttributesCount": 2} for _ in range(3)]
        yield "logs", {"resourceLogs": [{"resource": {"attributes": _odd_attrs(r)}, "scopeLogs": [{"scope": {"name": r.choice(["", "s"]), "attributes": _odd_attrs(r)}, "logRecords": records}, {"logRecords": records[:1]}]}]}
        spans = [{"traceId": b"t" * 16, "spanId": b"s" * 8, "parentSpanId": r.choice([b"", b"p" * 8, b"short"]), "name": r.choice(["", "n"]), "startTimeUnixNano": r.choice([0, 10]), "endTimeUnixNano": r.choice([0, 5, 30]), "attributes": _odd_attrs(r), "kind": r.randint(0, 7), "events": [{"timeUnixNano": 7, "name": "é", "attributes": _odd_attrs(r)}] * r.randint(0, 2), "links": [{"traceId": ids(16), "spanId": ids(8), "traceState": "w", "attributes": _odd_attrs(r)}] * r.randint(0, 2), "droppedEventsCount": 4} | ({"status": {"code": 2, "message": "m"}} if r.random() < 0.5 else {}) for _ in range(2)]
        yield "traces", {"resourceSpans": [{"resource": {"attributes": _odd_attrs(r)}, "scopeSpans": [{"spans": spans}]}]}
        point = lambda: {"timeUnixNano": 3, "startTimeUnixNano": r.choice([0, 2]), "attributes": _odd_attrs(r), "flags": 1, "exemplars": [{"timeUnixNano": 1, "traceId": ids(16), "filteredAttributes": _odd_attrs(r)} | r.choice([{}, {"asInt": 7}, {"asDouble": math.nan}, {"asDouble": 0.25}])] * r.randint(0, 2)}
        number = lambda: point() | r.choice([{"asInt": -3}, {"asDouble": 1.5}, {"asDouble": math.nan}, {"asDouble": -math.inf}, {}])
        hist = lambda: point() | {"count": (1 << 64) - 1, "sum": r.choice([1.0, math.nan]), "bucketCounts": [1, 1 << 63], "explicitBounds": [0.5, math.inf]}
        exp = lambda: point() | {"count": 2, "scale": -1, "zeroCount": 1, "zeroThreshold": r.choice([0.0, math.inf])} | r.choice([{}, {"positive": {"offset": -2, "bucketCounts": [1, 2]}}])
        metrics = [{"name": "g", "gauge": {"dataPoints": [number(), number()]}}, {"name": "s", "unit": "1", "sum": {"dataPoints": [number()], "aggregationTemporality": r.randint(0, 5), "isMonotonic": True}}, {"name": "h", "histogram": {"dataPoints": [hist()], "aggregationTemporality": 2}}, {"name": "e", "exponentialHistogram": {"dataPoints": [exp(), exp()]}}, {"name": "u", "summary": {"dataPoints": [{}, {}]}}, {"name": "nothing"}]
        yield "metrics", {"resourceMetrics": [{"resource": {"attributes": _odd_attrs(r)}, "scopeMetrics": [{"metrics": metrics}]}]}


@pytest.mark.parametrize("signal", ["logs", "traces", "metrics"])
def test_one_policy(spark, named, signal):
    """Odd values of every kind: Python rows and Column expressions say the same."""
    made = [wire.write(s, tree) for s, tree in _odd_requests(9) if s == signal]
    p = payloads(spark, *made, fmt="protobuf")
    p.createOrReplaceTempView("odd")
    transformed = getattr(t, f"transform_{signal}")(p, "protobuf")
    for table in (tf.SHAPES if signal == "metrics" else [signal]):
        want = _rows(_table(transformed, table))
        assert want and _rows(spark.sql(f"SELECT l.* FROM odd p, LATERAL otlp_{table}(p.payload, 'protobuf') l")) == want, table
    if signal == "metrics":
        sums = ", ".join(f"sum(s.{x})" for x in (*tf.SKIPPED, "total"))
        assert tuple(spark.sql(f"SELECT {sums} FROM odd p, LATERAL otlp_skipped(p.payload, 'protobuf') s").first()) == tuple(transformed.skipped.first())


def test_modes_and_errors(spark, named):
    good, bad = log(severityText="ok"), log(timeUnixNano="-1")
    payloads(spark, good, bad, log(traceId="ab"), "").createOrReplaceTempView("given")
    spark.sql("SELECT CAST(NULL AS BINARY) AS payload").createOrReplaceTempView("nothing")
    assert spark.sql("SELECT l.severity_text FROM given p, LATERAL otlp_logs(p.payload, 'json', 'permissive') l").collect() == [("ok",)]
    got = {r.payload_id: r.error for r in spark.sql("SELECT p.payload_id, e.error FROM given p, LATERAL otlp_error(p.payload, p.format, 'logs') e").collect()}
    assert set(got) == {1, 2, 3} and "timestamp" in got[1] and got[2] == "trace_id must be 16 bytes"
    with pytest.raises(Exception, match="invalid timestamp"):
        spark.sql("SELECT l.* FROM (SELECT * FROM given WHERE payload_id = 1) p, LATERAL otlp_logs(p.payload, 'json') l").collect()
    assert spark.sql("SELECT l.* FROM nothing p, LATERAL otlp_logs(p.payload) l").count() == 0
    assert spark.sql("SELECT l.body FROM otlp_logs(?, 'json') l", args=[log(body={"stringValue": "hi"})]).collect() == [("hi",)]


@pytest.mark.parametrize(("call", "says"), [
    ("otlp_logs(payload, 'xml')", "format must be one of"), ("otlp_logs(payload, 'json', 'lax')", "mode must be one of"), ("otlp_logs(1, 'json')", "payload must be"), ("otlp(payload, 'json', 'summary')", "table must be a constant"),
    ("otlp(payload, 'json', format)", "table must be a constant"), ("otlp_error(payload, 'json', 'spans')", "signal must be one of"),
])
def test_arguments_are_checked(spark, named, call, says):
    payloads(spark, log()).createOrReplaceTempView("given")
    with pytest.raises(Exception, match=says):
        spark.sql(f"SELECT l.* FROM given p, LATERAL {call} l").collect()


def test_split_messages_merge():
    """A singular message that comes in parts is one, by lists, messages and last values; of alternatives the last one stays."""
    part = lambda no, raw: wire._put(no << 3 | 2) + wire._put(len(raw)) + raw
    a, b = (wire.write("Resource", {"attributes": [attr(k, stringValue=k)]}) for k in "ab")
    got = wire.read("logs", part(1, part(1, a) + part(1, b)))
    assert [x["key"] for x in got["resourceLogs"][0]["resource"]["attributes"]] == ["a", "b"]
    scope = wire.write("Scope", {"name": "x"}) + wire.write("Scope", {"name": "y", "version": "1"})
    assert wire.read("Scope", scope) == {"name": "y", "version": "1"}
    value = wire.write("AnyValue", {"stringValue": "s"}) + wire.write("AnyValue", {"arrayValue": {"values": [{"intValue": 1}]}}) + wire.write("AnyValue", {"arrayValue": {"values": [{"intValue": 2}]}})
    assert wire.read("AnyValue", value) == {"arrayValue": {"values": [{"intValue": 1}, {"intValue": 2}]}}
    point = wire.write("NumberPoint", {"asInt": 3}) + wire.write("NumberPoint", {"asDouble": 0.5})
    assert wire.read("NumberPoint", point) == {"asDouble": 0.5}
    metric = wire.write("Metric", {"name": "m", "gauge": {"dataPoints": [{"asInt": 1}]}}) + wire.write("Metric", {"sum": {"dataPoints": [{"asInt": 2}]}}) + wire.write("Metric", {"sum": {"dataPoints": [{"asInt": 4}], "isMonotonic": True}})
    assert wire.read("Metric", metric) == {"name": "m", "sum": {"dataPoints": [{"asInt": 2}, {"asInt": 4}], "isMonotonic": True}}


def test_unknown_groups_are_skipped():
    tag = lambda no, wire_type: wire._put(no << 3 | wire_type)
    inner = tag(99, 3) + tag(1, 0) + wire._put(300) + tag(98, 3) + tag(2, 2) + wire._put(3) + b"abc" + tag(98, 4) + tag(3, 5) + b"1234" + tag(4, 1) + b"12345678" + tag(99, 4)
    assert wire.read("Scope", inner + wire.write("Scope", {"name": "x"}) + inner) == {"name": "x"}
    for broken in (inner[:-2], inner[:8], tag(99, 3) + tag(98, 4), tag(99, 4), tag(99, 3) * 200, tag(1, 3) + tag(1, 4)):
        with pytest.raises(wire.DecodeError):
            wire.read("Scope", broken)


@pytest.mark.parametrize("name", ["sql_lateral_logs", "sql_lateral_errors", "sql_lateral_points", "payload_log_logs", "payload_log_admission", "table_log_metrics", "trace_responses_typed", "star_ack_codes"])
def test_query_equals_sql(spark, sf, views, name):  # noqa: F811
    df = q.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = views.execute(f'SELECT {", ".join(chr(34) + c + chr(34) for c in cols)} FROM ({q.oracle_sql()[name]})').fetchall()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r) for r in df.select(*(F.col(f"`{c}`") for c in cols)).collect()), key=key) == sorted(want, key=key)
