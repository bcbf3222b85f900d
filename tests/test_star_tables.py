"""Rows of a message by column are those of windows and joins over star rows."""

import json

import pytest

from tidemark import queries, synth
from tidemark.operators.star import IRS
from tidemark.plans import transform
from tidemark.sources import star_session


def _rows(ir, columns):
    text = lambda r: json.dumps(r.asDict(True), default=lambda x: x.hex() if isinstance(x, bytes | bytearray) else str(x), sort_keys=True)
    return sorted(text(r) for r in ir.select(*columns).collect())


@pytest.mark.parametrize("made, signal", [("log_payloads", "logs"), ("child_payloads", "traces"), ("gauge_payloads", "metrics"), ("histogram_payloads", "metrics"), ("exp_histogram_payloads", "metrics")])
def test_same_rows(spark, sf, made, signal):
    messages = synth.star_messages(getattr(queries, made)(spark, sf), signal).localCheckpoint()
    by_column, by_windows = star_session.decode_rows(messages, signal), IRS[signal](star_session.decode_streams(messages, signal))
    # what a shape does not have is not read by its table
    columns = [c for c in by_windows.columns if c != "error"]
    found = _rows(by_column, columns)
    assert len(found) > 5 and found == _rows(by_windows, columns)


def _after_the_streams(messages, signal: str) -> str:
    """The plan of the tables above the decoder."""
    return transform.transform_star(messages, signal)._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_spans_are_not_exchanged(spark, sf):
    """One exchange deals messages to streams; none follows the decoder."""
    assert "Exchange" not in _after_the_streams(synth.star_messages(queries.span_payloads(spark, sf), "traces"), "traces")


def test_span_children_are_not_exchanged(spark, sf):
    """The plan of spans with events and links has no join, window or exchange, so it stays small in the driver."""
    plan = _after_the_streams(synth.star_messages(queries.child_payloads(spark, sf), "traces"), "traces")
    assert not any(x in plan for x in ("Exchange", "Join", "Window"))
