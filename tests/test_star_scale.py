"""Star streams of any length and number: writers and readers hold a message at a time, answers need no rows."""

import pyarrow as pa
import pytest

from tidemark import queries, queries_io, synth
from tidemark.sources import star_session, wire

from .test_engine import log


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_writer_keeps_nothing_that_was_sent():
    w = synth.Writer()
    tree = wire.read_json("logs", log(severityText="x" * 10_000).encode())
    first, second = (synth.log_star(tree, w) for _ in range(2))
    assert all(raw.getvalue() == b"" for raw, _ in w.open.values())
    s = star_session.Session()
    for sent in (first, second):
        assert s.message("logs", sent)["logs"]["severity_text"].to_pylist() == ["x" * 10_000]
    assert len(second[0]["record"]) < len(first[0]["record"])  # the schema went out once


def test_no_stream_is_one_group(spark, sf):
    """A stream is read and written a message at a time, not as a group that one task holds."""
    assert "FlatMapGroups" not in _plan(queries_io.star_ack_codes(spark, sf)) and "FlatMapGroups" not in _plan(queries.star_acks(spark, sf))


def test_record_of_two_batches():
    """What is left of a record is read with the next one, with and without dictionaries."""
    for kind in (pa.string(), pa.dictionary(pa.int8(), pa.string())):
        sink = pa.BufferOutputStream()
        batch = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.string()).cast(kind)], ["severity_text"])
        with pa.ipc.new_stream(sink, batch("a").schema) as w:
            w.write_batch(batch("a"))
            w.write_batch(batch("b"))
        record = sink.getvalue().to_pybytes()
        s = star_session.Session()
        assert s.payload(30, "s", record)[0].to_pylist() == ["a"]
        assert s.payload(30, "s", b"\xff\xff\xff\xff\x00\x00\x00\x00")[0].to_pylist() == ["b"]
        with pytest.raises(wire.DecodeError):
            s.payload(30, "s", b"\xff\xff\xff\xff\x00\x00\x00\x00")


def _broken(text: bytes | None, nested: bytes | None) -> bytes:
    """A record of logs whose text is no UTF-8, or whose body is no CBOR."""
    body = pa.StructArray.from_arrays([pa.array([6 if nested else 1], pa.uint8()), pa.array(["b"]), pa.array([nested], pa.binary())], ["type", "str", "ser"])
    bad = pa.StringArray.from_buffers(1, pa.array([text or b"t"], pa.binary()).buffers()[1], pa.py_buffer(text or b"t"))
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([bad, body], ["severity_text", "body"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def test_answers_are_those_of_the_rows(spark):
    """Fine messages, a full stream, wrong payloads, broken texts and broken nested values."""
    sent = lambda *records: [(f"s{i}", kind, bytearray(r)) for i, (kind, r) in enumerate(records)]
    whole = lambda n: [(p["schema_id"], p["type"], bytearray(p["record"])) for p in synth.log_star(wire.read_json("logs", log(severityText="x" * n).encode()), synth.Writer())]
    rows = [("fine", 0, whole(1)), ("full", 0, whole(60_000)), ("kind", 0, sent((40, b"x"))), ("cut", 0, sent((30, b"x"))), ("empty", 0, []), ("text", 0, sent((30, _broken(b"\xff", None)))), ("nested", 0, sent((30, _broken(None, b"\xff")))), ("nested", 1, whole(1)), ("good", 0, sent((30, _broken(None, b"\x81\x01"))))]
    messages = spark.createDataFrame(rows, synth.MESSAGE)
    told = lambda star: {(r.stream_id, r.batch_id): (r.status_code, r.message) for r in star_session.acks(star).collect()}
    found = told(star_session.outcomes(messages, "logs", budget=20_000))
    assert found == told(star_session.decode_streams(messages, "logs", budget=20_000))
    assert {k: v[0] for k, v in found.items()} == {("fine", 0): 0, ("full", 0): 8, ("kind", 0): 3, ("cut", 0): 3, ("empty", 0): 3, ("text", 0): 3, ("nested", 0): 3, ("good", 0): 0}


def test_batches_to_python_are_small(spark):
    """Payloads cross to Python in batches of a few MB, whatever the session's limit was; a smaller limit stays."""
    from tidemark.sources import batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert [batches._bytes(x) for x in ("67108864b", "8m", "16kb", "5")] == [64 << 20, 8 << 20, 16 << 10, 5]
    before = spark.conf.get(key)
    try:
        for given, held in (("64m", batches.BYTES), ("128m", batches.BYTES), ("1m", 1 << 20)):
            spark.conf.set(key, given)
            big = spark.range(0, 60, 1, 1).selectExpr("id as payload_id", "repeat('x', 1 << 20) as payload")
            sizes = batches.bounded(big).mapInArrow(lambda it: (b.from_pydict({"n": [b.nbytes]}) for b in it), "n bigint").collect()
            assert batches._bytes(spark.conf.get(key)) == held and len(sizes) >= 6 and max(r.n for r in sizes) <= held + (2 << 20)
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["logs_star", "metrics_gauge_star", "star_acks", "logs_star_attr_kinds"])
def test_star_queries_hold_no_stream(spark, sf, name):
    """No stream is a group of one task, in writing or in reading."""
    assert "FlatMapGroups" not in _plan(queries.queries()[name](spark, sf))
