"""Status codes, stream budgets, streams that close on refused messages, sink failures, hot services."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import synth
from tidemark.sources import sinks, star_session, star_types, table_log, wire
from tidemark.streaming import ingest, status

from .test_engine import log


def test_codes(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 7, 8, 10, 13, 14, 16)], "c int").select("c", status.name_of(F.col("c")).alias("n")).collect()
    assert {r.n: r.c for r in rows if r.n} == status.CODES and [r.c for r in rows if r.n is None] == [2]
    assert {k: (status.code(k), status.words(k)) for k in status.OUTCOMES} == status.OUTCOMES


def _ids(values, plain=False, kind=None):
    field = pa.field("id", kind or pa.uint16(), metadata={"encoding": "plain"} if plain else None)
    return pa.RecordBatch.from_arrays([pa.array(values, field.type)], schema=pa.schema([field]))


@pytest.mark.parametrize(("table", "batch", "fine"), [
    ("logs", _ids([65535]), True), ("logs", _ids([65535, None, 0]), True), ("logs", _ids([65535, 1]), False), ("logs", _ids([65535, 1], plain=True), True), ("logs", _ids([]), True),
    ("events", _ids([65535, 1], kind=pa.uint32()), True), ("events", _ids([(1 << 32) - 1, 1], kind=pa.uint32()), False),
    ("logs", pa.RecordBatch.from_arrays([pa.array([{"id": 65535}, {"id": 1}], pa.struct([("id", pa.uint16())]))], ["resource"]), False),
    ("number_points", pa.RecordBatch.from_arrays([pa.array([60000, 6000], pa.uint16())], ["parent_id"]), False),
    ("spans", pa.RecordBatch.from_arrays([pa.array([b"t" * 16], pa.binary(16)), pa.array([b"s" * 8], pa.binary(8))], ["trace_id", "span_id"]), True),
    ("spans", pa.RecordBatch.from_arrays([pa.array([b"t" * 16], pa.binary(16)), pa.array([bytes(8)], pa.binary(8))], ["trace_id", "span_id"]), False),
    ("spans", pa.RecordBatch.from_arrays([pa.array([b"t" * 16], pa.binary(16))], ["trace_id"]), False),
])
def test_refused_messages(table, batch, fine):
    if fine:
        star_types.refuse({table: batch})
    else:
        with pytest.raises(wire.DecodeError):
            star_types.refuse({table: batch})


def test_budget():
    room = star_session.Budget(10)
    sent = lambda n: [{"schema_id": "s", "record": bytes(n - 1)}]
    assert [room.takes(sent(n)) for n in (6, 5, 4, 1)] == [True, False, True, False]
    assert star_session.Budget(None).takes(sent(1 << 20))


def _messages(spark, path, *sizes, stream="s"):
    """A message of one log with so long a text each, in one stream."""
    w = synth.Writer()
    for i, n in enumerate(sizes):
        tree = wire.read_json("logs", log(severityText="x" * n).encode())
        sent = [(p["schema_id"], p["type"], bytearray(p["record"])) for p in synth.log_star(tree, w)]
        spark.createDataFrame([(stream, i, sent)], synth.MESSAGE).coalesce(1).write.mode("append").parquet(path)


def test_streams_without_room_go_on(spark, tmp_path, monkeypatch):
    """A message without room is answered so and its stream goes on; a batch that cannot be written is answered as an internal error."""
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    _messages(spark, src, 10, 60_000, 20)
    run = lambda **kw: ingest.ingest_star(ingest.read_payloads(spark, src, synth.MESSAGE, 100), "logs", out, check, atomic=True, **kw).awaitTermination()
    run(budget=20_000)
    lg = table_log.TableLog(spark, out)
    assert {r.batch_id: (r.status_code, r.message) for r in lg.read("acks").collect()} == {0: (0, ""), 1: (8, "ingest buffer full"), 2: (0, "")}
    assert sorted((r.batch_id, len(r.severity_text)) for r in lg.read("logs").collect()) == [(0, 10), (2, 20)]
    real = table_log.with_field_ids

    def broken(table):
        if "severity_text" in table.columns:
            raise RuntimeError("disk is full")
        return real(table)

    monkeypatch.setattr(table_log, "with_field_ids", broken)
    _messages(spark, src, 30, stream="t")
    run(answer_failures=True)
    assert {(r.status_code, r.message) for r in lg.read("acks").where("commit = 1").collect()} == {(13, "ingest error")} and lg.read("logs").count() == 2


def test_hot_service(spark, tmp_path):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("service_name"), F.col("id").alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join such small parts
    try:
        sinks.write_by_service(rows, str(tmp_path / "out"), rows_a_task=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("service_name", "x").collect())) == sorted(map(tuple, rows.collect())) and back.where("service <> service_name").count() == 0
    files = lambda s: len([f for f in os.listdir(tmp_path / f"out/service={s}") if f.endswith(".parquet")])
    assert files("hot") > 1 and files("s1") == 1
