"""The six output tables and the intermediate rows that every decoder emits.

Nanosecond times are BIGINT (Spark timestamps are microseconds) and unsigned
64-bit counts are DECIMAL(20,0).
"""

from __future__ import annotations

from pyspark.sql import types as T

ANY = "struct<kind:tinyint,str:string,int:bigint,dbl:double,bool:boolean,bytes:binary,json:string>"
ATTRS = f"array<struct<key:string,value:{ANY}>>"
#: Kinds of a value; 5 and 6 carry rendered JSON.
EMPTY, STR, INT, DOUBLE, BOOL, MAP, SLICE, BYTES = range(8)
#: Shapes of a metric point.
GAUGE, SUM, HISTOGRAM, EXP_HISTOGRAM, SUMMARY = range(1, 6)
U64 = "decimal(20,0)"

_KEY = "payload_id bigint, resource_ord int, scope_ord int, metric_ord int, record_ord int"
_CONTEXT = f"resource_attrs {ATTRS}, scope_name string, scope_version string, scope_attrs {ATTRS}"
_EVENT = f"array<struct<time:bigint,name:string,attrs:{ATTRS}>>"
_LINK = f"array<struct<trace_id:binary,span_id:binary,trace_state:string,attrs:{ATTRS}>>"
_EXEMPLAR = f"array<struct<time:bigint,trace_id:binary,span_id:binary,int_value:bigint,double_value:double,attrs:{ATTRS}>>"

LOG_IR = f"{_KEY}, {_CONTEXT}, time bigint, observed bigint, trace_id binary, span_id binary, severity_number int, severity_text string, event_name string, body {ANY}, attrs {ATTRS}, dropped bigint, flags bigint, error string"
SPAN_IR = f"{_KEY}, {_CONTEXT}, start bigint, end bigint, trace_id binary, span_id binary, parent_span_id binary, trace_state string, name string, kind int, status_code int, status_message string, attrs {ATTRS}, events {_EVENT}, links {_LINK}, dropped_attributes bigint, dropped_events bigint, dropped_links bigint, flags bigint, error string"
POINT_IR = (
    f"{_KEY}, {_CONTEXT}, shape tinyint, name string, description string, unit string, time bigint, start bigint, int_value bigint, double_value double, "
    f"count {U64}, sum double, min double, max double, bucket_counts array<{U64}>, explicit_bounds array<double>, scale int, zero_count {U64}, zero_threshold double, "
    f"positive_offset int, positive_counts array<{U64}>, negative_offset int, negative_counts array<{U64}>, attrs {ATTRS}, flags bigint, exemplars {_EXEMPLAR}, temporality int, monotonic boolean, error string"
)
IR = {"logs": LOG_IR, "traces": SPAN_IR, "metrics": POINT_IR}

_SERVICE = "service_name STRING NOT NULL, service_namespace STRING, service_instance_id STRING"
_SCOPE = "resource_attributes STRING, scope_name STRING, scope_version STRING, scope_attributes STRING"
_HEAD = "time_unix_nano BIGINT NOT NULL, start_time_unix_nano BIGINT, name STRING NOT NULL, description STRING, unit STRING"
_TAIL = f"{_SERVICE}, {_SCOPE}, metric_attributes STRING, flags BIGINT, exemplars_json STRING"
LOGS = f"time_unix_nano BIGINT, observed_time_unix_nano BIGINT, trace_id BINARY, span_id BINARY, {_SERVICE}, severity_number INT, severity_text STRING, event_name STRING, body STRING, {_SCOPE}, log_attributes STRING, dropped_attributes_count BIGINT, flags BIGINT"
TRACES = f"start_time_unix_nano BIGINT NOT NULL, duration_time_unix_nano BIGINT NOT NULL, trace_id BINARY NOT NULL, span_id BINARY NOT NULL, parent_span_id BINARY, trace_state STRING, {_SERVICE}, name STRING NOT NULL, kind INT, status_code INT, status_status_message STRING, {_SCOPE}, span_attributes STRING, events_json STRING, links_json STRING, dropped_attributes_count BIGINT, dropped_events_count BIGINT, dropped_links_count BIGINT, flags BIGINT"
GAUGE_TABLE = f"{_HEAD}, int_value BIGINT, double_value DOUBLE, {_TAIL}"
SUM_TABLE = f"{GAUGE_TABLE}, aggregation_temporality INT, is_monotonic BOOLEAN"
HISTOGRAM_TABLE = f"{_HEAD}, count {U64}, sum DOUBLE, min DOUBLE, max DOUBLE, bucket_counts ARRAY<{U64}>, explicit_bounds ARRAY<DOUBLE>, {_TAIL}, aggregation_temporality INT"
EXP_HISTOGRAM_TABLE = f"{_HEAD}, count {U64}, sum DOUBLE, min DOUBLE, max DOUBLE, scale INT, zero_count {U64}, zero_threshold DOUBLE, positive_offset INT, positive_bucket_counts ARRAY<{U64}>, negative_offset INT, negative_bucket_counts ARRAY<{U64}>, {_TAIL}, aggregation_temporality INT"
TABLES = {"logs": LOGS, "traces": TRACES, "gauge": GAUGE_TABLE, "sum": SUM_TABLE, "histogram": HISTOGRAM_TABLE, "exp_histogram": EXP_HISTOGRAM_TABLE}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
