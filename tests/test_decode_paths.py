"""JSON and JSONL payloads: one parse a payload, native rows and those of the readers in one plan."""

import json

import pytest

from tidemark import queries as q
from tidemark.plans import transform as t
from tidemark.sources import wire
from tidemark.sources.decode import decode

from .test_engine import attr, log, payloads


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _tables(spark, sf, mode):
    yield t.transform_logs(q.log_payloads(spark, sf), "json", mode)
    yield t.transform_traces(q.child_payloads(spark, sf), "json", mode)
    yield t.transform_logs(q.log_payloads(spark, sf), "jsonl", mode)
    m = t.transform_metrics(q.gauge_payloads(spark, sf), "json", mode)
    yield from (m.gauge, m.histogram, m.skipped)


@pytest.mark.parametrize("mode", ["failfast", "permissive"])
def test_one_parse_a_payload(spark, sf, mode):
    for df in _tables(spark, sf, mode):
        plan = _plan(df)
        assert plan.count("from_json(") == 1 and "Union" not in plan and "Join" not in plan


def test_all_shapes_from_one_parse(spark, sf):
    """Counts of all shapes in one pass: the shape is beside the points, not in branches."""
    ir = decode(q.gauge_payloads(spark, sf), "metrics", "json")
    assert _plan(ir.groupBy("shape").count()).count("from_json(") == 1


def _ir(spark, signal, *texts, fmt="json", whole=False):
    rows = decode(payloads(spark, *texts, fmt=fmt), signal, fmt, whole).orderBy("payload_id", "resource_ord", "scope_ord", "metric_ord", "record_ord").collect()
    return [r.asDict(recursive=True) for r in rows]


LINES = [log(severityText="a", attributes=[attr("k", intValue="5")]), log(severityText="b", timeUnixNano="7")]


@pytest.mark.parametrize("nested", [False, True])
def test_jsonl_lines(spark, nested):
    """The same rows and order from lines, whether they stay in Spark or go to the reader; blank lines count for nothing."""
    more = [log(body={"arrayValue": {"values": [{"intValue": 1}]}})] if nested else []
    got = _ir(spark, "logs", "\n \t\r\n" + "\n\n".join(LINES + more) + "\r\n\n", fmt="jsonl")
    assert [(r["resource_ord"], r["severity_text"], r["time"], r["error"]) for r in got] == [(0, "a", 0, None), (1, "b", 7, None)] + [(2, None, 0, None)] * nested
    two = json.loads(LINES[0])
    two["resourceLogs"] *= 2  # a line with several resources
    assert [r["resource_ord"] for r in _ir(spark, "logs", json.dumps(two) + "\n" + LINES[1], fmt="jsonl")] == [0, 1, 2]


def test_jsonl_errors(spark):
    texts = ["\n".join([LINES[0], "", '{"resourceLogs": 5}']), "\n".join([*LINES, "{"]), " \n\n", "", "\n".join([LINES[0], log(timeUnixNano="x")])]
    p = payloads(spark, *texts, LINES[0], fmt="jsonl")
    got = {r.payload_id: r.error for r in t.errors_of(p, "logs", "jsonl").collect()}
    assert [got[i].split(":")[0] for i in range(5)] == ["line 3", "line 3", "no records", "no records", "line 2"] and len(got) == 5
    assert [r.severity_text for r in t.transform_logs(p, "jsonl", "permissive").collect()] == ["a"]


BAD = [
    ("logs", log(timeUnixNano="-1")), ("logs", log(observedTimeUnixNano=str(1 << 63))), ("logs", log(traceId="zz!")), ("logs", log(traceId="abcd")), ("logs", log(spanId="ab" * 16)), ("logs", log(severityNumber="LOUD")),
    ("logs", log(severityNumber="")), ("logs", log() + " x"), ("logs", "[]"), ("logs", '{"resourceLogs": null}'), ("logs", log(body={"doubleValue": "NaN"})),
    *(("traces", json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "ab" * 16, "spanId": "cd" * 8} | x]}]}]})) for x in ({"traceId": ""}, {"spanId": "00" * 8}, {"traceId": "ab" * 8}, {"kind": "X"}, {"status": {"code": "BAD"}}, {"events": [{"timeUnixNano": "x"}]}, {"links": [{"traceId": "?"}]}, {"endTimeUnixNano": "1.5"})),
    *(("metrics", json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "sum": {"dataPoints": [{"asInt": "1"}]}}, m]}]}]})) for m in ({"sum": {"aggregationTemporality": "X", "dataPoints": [{"asInt": "1"}]}}, {"gauge": {"dataPoints": [{"timeUnixNano": "x"}]}}, {"gauge": {"dataPoints": [{"exemplars": [{"timeUnixNano": "-5"}]}]}}, {"histogram": {"dataPoints": [{"exemplars": [{"traceId": "?"}]}]}}, {"sum": {"dataPoints": [{"asDouble": "x"}]}})),
]


def test_whole_payloads(spark):
    """A payload with an error has one row that says the reader's error, whichever record holds it, and failfast raises for it."""
    for signal in ("logs", "traces", "metrics"):
        texts = [x for s, x in BAD if s == signal]
        got = _ir(spark, signal, *texts, whole=True)
        assert [r["payload_id"] for r in got] == list(range(len(texts))) and all(r["error"] for r in got), signal
        p = payloads(spark, *texts)
        tables = t.transform_metrics(p, "json", "permissive").tables().values() if signal == "metrics" else [getattr(t, f"transform_{signal}")(p, "json", "permissive")]
        assert [x.count() for x in tables] == [0] * len(tables)
        assert t.errors_of(p, signal, "json").count() == len(texts)
    for signal, text in BAD[:3] + BAD[11:13] + BAD[-2:]:
        made = t.transform_metrics(payloads(spark, text), "json").gauge if signal == "metrics" else getattr(t, f"transform_{signal}")(payloads(spark, text), "json")
        with pytest.raises(Exception, match="payload 0: |trace_id|span_id"):
            made.unionByName(made).collect()


def test_errors_in_the_middle(spark):
    """A bad record in a large good payload takes the payload; other payloads keep all their rows in order."""
    good = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"severityText": f"{i}"} for i in range(20)]}] * 2}]}
    bad = json.loads(json.dumps(good))
    bad["resourceLogs"][0]["scopeLogs"][1]["logRecords"][7]["traceId"] = "abc!"
    p = payloads(spark, json.dumps(good), json.dumps(bad), json.dumps(good))
    rows = t.transform_logs(p, "json", "permissive", keep_order=True).orderBy("payload_id", "scope_ord", "record_ord").collect()
    assert [(r.payload_id, r.scope_ord, r.severity_text) for r in rows] == [(k, s, str(i)) for k in (0, 2) for s in (0, 1) for i in range(20)]
    assert [(r.payload_id, r.error) for r in t.errors_of(p, "logs", "json").collect()] == [(1, "invalid id 'abc!'")]


def test_mixed_formats_in_one_plan(spark):
    tree = wire.read_json("logs", LINES[0].encode())
    rows = [(0, LINES[0].encode(), "json"), (1, "\n".join(LINES).encode(), "jsonl"), (2, wire.write("logs", tree), "protobuf"), (3, LINES[0].encode(), "AUTO"), (4, "\n".join(LINES).encode(), "auto"), (5, wire.write("logs", tree), "auto"), (6, b"{", "json"), (7, b"", "auto"), (8, None, "json"), (9, LINES[0].encode(), "xml")]
    p = spark.createDataFrame([(i, None if d is None else bytearray(d), f) for i, d, f in rows], "payload_id long, payload binary, format string")
    got = {}
    for r in t.transform_logs(p, None, "permissive", keep_order=True).orderBy("payload_id", "resource_ord").collect():
        got.setdefault(r.payload_id, []).append(r.severity_text)
    assert got == {0: ["a"], 1: ["a", "b"], 2: ["a"], 3: ["a"], 4: ["a", "b"], 5: ["a"]}
    assert {r.payload_id for r in t.errors_of(p, "logs").collect()} == {6, 8, 9}


def test_points_of_all_shapes_in_order(spark):
    metrics = [{"name": "a", "gauge": {"dataPoints": [{"asInt": "1"}, {"asInt": "2"}]}}, {"name": "none"}, {"name": "b", "sum": {"dataPoints": [{"asDouble": 1.5, "count": 3}]}}, {"name": "c", "summary": {"dataPoints": [{}, {"sum": 1}]}}, {"name": "d", "exponentialHistogram": {"dataPoints": [{"scale": 2, "zeroCount": "3", "positive": {"offset": 1, "bucketCounts": ["7"]}}]}}, {"name": "e", "histogram": {"dataPoints": [{"count": "4", "explicitBounds": [1.5]}]}, "gauge": {"dataPoints": [{"asInt": "9"}]}}]
    text = json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": metrics}]}]})
    native = _ir(spark, "metrics", text)
    read = [{**r, "payload_id": 0} for r in _ir(spark, "metrics", text.replace('"name": "none"', '"name": "none", "unit": null'))]  # a null goes to the reader
    assert [(r["metric_ord"], r["record_ord"], r["shape"], r["name"]) for r in native] == [(0, 0, 1, "a"), (0, 1, 1, "a"), (2, 0, 2, "b"), (3, 0, 5, "c"), (3, 1, 5, "c"), (4, 0, 4, "d"), (5, 0, 1, "e")]
    for a, b in zip(native, read, strict=True):
        if a["shape"] != 5:  # the readers leave what a shape does not have empty, or give its default
            assert {k: v for k, v in a.items() if v not in (None, [], 0, 0.0)} == {k: v for k, v in b.items() if v not in (None, [], 0, 0.0)}
    m = t.transform_metrics(payloads(spark, text), "json")
    assert [m.tables()[k].count() for k in ("gauge", "sum", "histogram", "exp_histogram")] == [3, 1, 0, 1] and m.skipped.first().summaries == 2


def test_readers_give_rows_in_parts():
    """Rows of an Arrow batch of payloads come in parts, in order, one list a payload, null where nothing was asked."""
    import pyarrow as pa

    from tidemark.sources import decode as d

    made = lambda n: wire.write("logs", {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"severityText": f"{n}-{i}", "body": {"stringValue": "x" * 500}} for i in range(n)]}]}]})
    sizes = [None, 3000, 0, 5000, None, 7000, 1, 9000]
    batch = (pa.array([None if n is None else made(n) for n in sizes], pa.binary()), pa.array(["protobuf"] * len(sizes)))
    kind = pa.list_(pa.struct([("severity_text", pa.string()), ("body", pa.struct([("str", pa.string())])), ("error", pa.string())]))
    parts = list(d._lists("logs", [batch, (batch[0][:0], batch[1][:0])], kind))
    assert len(parts) >= 3 and sum(len(p) for p in parts) == len(sizes)
    rows = [x for p in parts for x in p.to_pylist()]
    assert [None if r is None else len(r) for r in rows] == sizes
    assert [r["severity_text"] for r in rows[3]] == [f"5000-{i}" for i in range(5000)]
