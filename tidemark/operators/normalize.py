"""Intermediate rows to the six output tables: the only normalization policy, whatever the input encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.render import attribute_text, attributes_json, body_text, events_json, exemplars_json, id_or_null, links_json
from ..functions.text import finite, none_if_empty
from ..schemas import EXP_HISTOGRAM, GAUGE, HISTOGRAM, SUM, SUMMARY

ORDINALS = ["payload_id", "resource_ord", "scope_ord", "metric_ord", "record_ord"]


def _context() -> list[Column]:
    r = F.col("resource_attrs")
    return [
        F.coalesce(attribute_text(r, "service.name"), F.lit("unknown")).alias("service_name"),
        attribute_text(r, "service.namespace").alias("service_namespace"),
        attribute_text(r, "service.instance.id").alias("service_instance_id"),
    ]


def _scope() -> list[Column]:
    return [attributes_json(F.col("resource_attrs")).alias("resource_attributes"), none_if_empty(F.col("scope_name")).alias("scope_name"), none_if_empty(F.col("scope_version")).alias("scope_version"), attributes_json(F.col("scope_attrs")).alias("scope_attributes")]


def _wrong(c: Column, width: int) -> Column:
    return c.isNotNull() & ~F.octet_length(c).isin(0, width)


def with_errors(ir: DataFrame, signal: str) -> DataFrame:
    """Add what normalization itself refuses to ``error``: ids of a wrong width, required ids that are missing."""
    t, s = F.col("trace_id"), F.col("span_id")
    if signal == "logs":
        found = F.when(_wrong(t, 16), "trace_id must be 16 bytes").when(_wrong(s, 8), "span_id must be 8 bytes")
    elif signal == "traces":
        found = F.when(id_or_null(t, 16).isNull(), "trace_id must be 16 bytes, got 0").when(id_or_null(s, 8).isNull(), "span_id must be 8 bytes, got 0")
    else:
        return ir
    return ir.withColumn("error", F.coalesce("error", found))


def logs(ir: DataFrame, keep: list[str] = ()) -> DataFrame:
    time = lambda c: F.nullif(F.col(c), F.lit(0).cast("bigint"))
    return ir.select(
        *keep, time("time").alias("time_unix_nano"), time("observed").alias("observed_time_unix_nano"), id_or_null(F.col("trace_id"), 16).alias("trace_id"), id_or_null(F.col("span_id"), 8).alias("span_id"),
        *_context(), F.nullif(F.col("severity_number"), F.lit(0)).alias("severity_number"), none_if_empty(F.col("severity_text")).alias("severity_text"), none_if_empty(F.col("event_name")).alias("event_name"),
        body_text(F.col("body")).alias("body"), *_scope(), attributes_json(F.col("attrs")).alias("log_attributes"), F.coalesce("dropped", F.lit(0)).alias("dropped_attributes_count"), F.coalesce("flags", F.lit(0)).alias("flags"),
    )


def traces(ir: DataFrame, keep: list[str] = ()) -> DataFrame:
    return ir.select(
        *keep, F.col("start").alias("start_time_unix_nano"), F.greatest(F.col("end") - F.col("start"), F.lit(0)).alias("duration_time_unix_nano"),
        id_or_null(F.col("trace_id"), 16).alias("trace_id"), id_or_null(F.col("span_id"), 8).alias("span_id"), id_or_null(F.col("parent_span_id"), 8).alias("parent_span_id"), none_if_empty(F.col("trace_state")).alias("trace_state"),
        *_context(), "name", F.nullif(F.col("kind"), F.lit(0)).alias("kind"), "status_code", none_if_empty(F.col("status_message")).alias("status_status_message"), *_scope(),
        attributes_json(F.col("attrs")).alias("span_attributes"), events_json(F.col("events")).alias("events_json"), links_json(F.col("links")).alias("links_json"),
        F.col("dropped_attributes").alias("dropped_attributes_count"), F.col("dropped_events").alias("dropped_events_count"), F.col("dropped_links").alias("dropped_links_count"), "flags",
    )


def kept_point() -> Column:
    """Number points need a finite value; other shapes keep all points but summaries."""
    number = F.col("shape").isin(GAUGE, SUM)
    return F.when(number, F.col("int_value").isNotNull() | finite(F.col("double_value"))).otherwise(F.col("shape") != SUMMARY)


def skipped(ir: DataFrame) -> DataFrame:
    """One row: points left out, by reason."""
    number = F.col("shape").isin(GAUGE, SUM) & F.col("int_value").isNull()
    d = F.col("double_value")
    out = ir.agg(
        F.count_if(F.col("shape") == SUMMARY).alias("summaries"), F.count_if(number & F.isnan(d)).alias("nan_values"),
        F.count_if(number & (F.abs(d) == float("inf"))).alias("infinity_values"), F.count_if(number & d.isNull()).alias("missing_values"),
    )
    return out.withColumn("total", F.expr("summaries + nan_values + infinity_values + missing_values"))


def metrics(ir: DataFrame, table: str, keep: list[str] = ()) -> DataFrame:
    shape = {"gauge": GAUGE, "sum": SUM, "histogram": HISTOGRAM, "exp_histogram": EXP_HISTOGRAM}[table]
    head = [F.col("time").alias("time_unix_nano"), F.nullif(F.col("start"), F.lit(0).cast("bigint")).alias("start_time_unix_nano"), F.col("name"), F.col("description"), F.col("unit")]
    tail = [*_context(), *_scope(), attributes_json(F.col("attrs")).alias("metric_attributes"), F.col("flags"), exemplars_json(F.col("exemplars")).alias("exemplars_json")]
    or_null = lambda c: F.when(finite(F.col(c)), F.col(c))
    stats = [F.col("count"), *(or_null(c).alias(c) for c in ("sum", "min", "max"))]
    own = {
        "gauge": [F.col("int_value"), F.when(F.col("int_value").isNull(), F.col("double_value")).alias("double_value")],
        "histogram": [*stats, F.col("bucket_counts"), F.transform("explicit_bounds", lambda b: F.when(finite(b), b)).alias("explicit_bounds")],
        "exp_histogram": [*stats, F.col("scale"), F.col("zero_count"), or_null("zero_threshold").alias("zero_threshold"), F.col("positive_offset"), F.col("positive_counts").alias("positive_bucket_counts"), F.col("negative_offset"), F.col("negative_counts").alias("negative_bucket_counts")],
    }
    last = {"sum": [F.col("temporality").alias("aggregation_temporality"), F.col("monotonic").alias("is_monotonic")], "gauge": []}.get(table, [F.col("temporality").alias("aggregation_temporality")])
    return ir.where((F.col("shape") == shape) & kept_point()).select(*keep, *head, *own.get(table, own["gauge"]), *tail, *last)
