"""Observation of transforms: counters of a table, and times of phases.  It never changes a result.

Counters that are sums over rows come with the action that writes the table
(``observed``, no second pass); those about repeated contexts need a distinct
count and are a query of their own (``counters``).  A phase is what can be timed
from outside a lazy plan: the action that decodes, normalizes or delivers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..sources.decode import decode

PHASES = ("protobuf_decode", "json_decode", "jsonl_decode", "auto_decode", "normalize", "deliver")
Observer = Callable[[str, str, float], None]


def _row_counters() -> dict[str, Column]:
    out = {"output_rows": F.count("*")}
    for side in ("resource", "scope"):
        text = F.col(f"{side}_attributes")
        out[f"{side}_attributes_row_copies"] = F.count(text)
        out[f"{side}_attributes_row_copy_bytes"] = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint")
    return out


def observed(table: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
    """The table, and an observation that is filled by the first action on it."""
    seen = Observation(name) if name else Observation()
    return table.observe(seen, *(c.alias(k) for k, c in _row_counters().items())), seen


def report(seen: Observation, signal: str) -> list[dict]:
    """Counters of an observation; those that are 0 are left out."""
    return [{"signal": signal, "counter": k, "value": v} for k, v in seen.get.items() if v]


def counters(table: DataFrame, signal: str) -> DataFrame:
    """(signal, counter, value): all counters of a table with its ordinals; those that are 0 are left out.

    A context repeats (``hit``) where its payload has an equal one before.
    """
    sides = {"resource": (["payload_id", "resource_ord"], ["resource_attributes"]), "scope": (["payload_id", "resource_ord", "scope_ord"], ["scope_name", "scope_version", "scope_attributes"])}
    rows = table.agg(*(c.alias(k) for k, c in _row_counters().items()))
    found = [rows.select(F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in _row_counters())), F.array(*_row_counters()))).alias("counter", "value"))]
    for side, (key, content) in sides.items():
        groups = table.select(*key, F.xxhash64(*content).alias("h")).distinct().groupBy("payload_id", "h").count()
        misses = groups.agg(F.count("*").alias("miss"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("hit"))
        found.append(misses.select(F.explode(F.create_map(F.lit(f"{side}_context_duplicate_hit"), F.col("hit"), F.lit(f"{side}_context_duplicate_miss"), F.col("miss"))).alias("counter", "value")))
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.where("value > 0").select(F.lit(signal).alias("signal"), "counter", F.col("value").cast("bigint").alias("value"))


@contextmanager
def phase(observer: Observer | None, signal: str, name: str) -> Iterator[None]:
    """Time a block that runs an action; ``observer`` gets (signal, phase, seconds), None is told nothing."""
    began = time.perf_counter()
    yield
    if observer is not None:
        observer(signal, name, time.perf_counter() - began)


def decode_json(payloads: DataFrame, signal: str, fmt: str, observer: Observer | None = None) -> DataFrame:
    """Intermediate rows of JSON or JSONL payloads; with an observer they are decoded (and kept) at once and timed."""
    if fmt not in ("json", "jsonl"):
        raise ValueError(f"expected JSON or JSONL {signal} input")
    ir = decode(payloads, signal, fmt)
    if observer is not None:
        ir = ir.persist()
        with phase(observer, signal, f"{fmt}_decode"):
            ir.count()
    return ir
