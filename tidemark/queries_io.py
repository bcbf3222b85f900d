"""Queries of the SQL functions, the payload source and the committed sink, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import queries as q, synth
from .plans import table_functions, transform
from .queries import query
from .schemas import ANY, BOOL, BYTES, DOUBLE, INT, STR
from .sources import payload_log, star_session, table_log, trace_lookup
from .sources.folders import new_folder
from .streaming import status


def _files(sf_dir: str, name: str) -> str:
    return "parquet.`" + f"{sf_dir}/{name}.parquet".replace("`", "``") + "`"


#: One JSON request of up to 500 events of a type, from plain columns.
_LOG_REQUESTS = """
SELECT event_type, to_json(named_struct('resourceLogs', array(named_struct(
    'resource', named_struct('attributes', array(named_struct('key', 'service.name', 'value', named_struct('stringValue', 'svc-' || event_type)))),
    'scopeLogs', array(named_struct('scope', named_struct('name', 'events'), 'logRecords', collect_list(named_struct(
        'timeUnixNano', CAST(unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS STRING), 'severityNumber', 'SEVERITY_NUMBER_WARN', 'body', named_struct('stringValue', props),
        'attributes', array(named_struct('key', 'user', 'value', named_struct('intValue', CAST(user_id AS STRING)))), 'traceId', md5(CAST(event_id AS STRING)))))))))) AS payload
FROM {events} GROUP BY event_type, event_id DIV 500"""


@query("""SELECT event_type, epoch_us(ts) * 1000 AS time_unix_nano, md5(event_id::VARCHAR) AS trace_id, 'svc-' || event_type AS service_name, 13 AS severity_number, props AS body, '{"user":' || user_id || '}' AS log_attributes FROM events""")
def sql_lateral_logs(spark, sf_dir):
    """SQL alone: requests are built, read by the table function and joined to their rows."""
    table_functions.register(spark)
    return spark.sql(f"""SELECT p.event_type, l.time_unix_nano, lower(hex(l.trace_id)) AS trace_id, l.service_name, l.severity_number, l.body, l.log_attributes
        FROM ({_LOG_REQUESTS.format(events=_files(sf_dir, "events"))}) p, LATERAL otlp_logs(p.payload, 'json') l""")


@query("""SELECT 'svc-' || event_type AS service_name, count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS refused FROM events GROUP BY event_type""")
def sql_lateral_errors(spark, sf_dir):
    """Payloads of one record, every fifth with an id that is none: the rest become rows, those get an error."""
    table_functions.register(spark)
    return spark.sql(f"""
        WITH p AS (SELECT event_type, '{{"resourceLogs":[{{"scopeLogs":[{{"logRecords":[{{"traceId":"' || CASE WHEN event_id % 5 = 0 THEN '?' ELSE md5(CAST(event_id AS STRING)) END || '"}}]}}]}}]}}' AS payload FROM {_files(sf_dir, "events")}),
        told AS (SELECT p.event_type, 1L AS refused FROM p, LATERAL otlp_error(p.payload, 'auto', 'logs') e UNION ALL SELECT p.event_type, 0L FROM p, LATERAL otlp_logs(p.payload, 'json', 'permissive') l)
        SELECT 'svc-' || event_type AS service_name, count(*) AS n, sum(refused) AS refused FROM told GROUP BY event_type""")


@query("""SELECT l_returnflag AS flag, l_linestatus AS name, 1::INT AS aggregation_temporality, count(*) AS points, sum(l_quantity::BIGINT)::BIGINT AS total, count(*) FILTER (l_linenumber = 7) AS skipped
  FROM lineitem GROUP BY ALL""")
def sql_lateral_points(spark, sf_dir):
    """The table's name as a constant argument; points without a value are counted by their own function."""
    table_functions.register(spark)
    return spark.sql(f"""
        WITH requests AS (
          SELECT l_returnflag AS flag, l_linestatus AS mode, to_json(named_struct('resourceMetrics', array(named_struct('scopeMetrics', array(named_struct('metrics', array(named_struct(
            'name', l_linestatus, 'sum', named_struct('aggregationTemporality', 'AGGREGATION_TEMPORALITY_DELTA', 'dataPoints', collect_list(
              CASE WHEN l_linenumber = 7 THEN named_struct('asInt', CAST(NULL AS STRING), 'timeUnixNano', '1') ELSE named_struct('asInt', CAST(CAST(l_quantity AS BIGINT) AS STRING), 'timeUnixNano', '1') END)))))))))) AS payload,
            sum(CASE WHEN l_linenumber = 7 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS unseen
          FROM {_files(sf_dir, "lineitem")} GROUP BY l_returnflag, l_linestatus, l_orderkey DIV 1000),
        points AS (SELECT r.flag, m.name, m.aggregation_temporality, count(*) AS n, sum(m.int_value) AS v FROM requests r, LATERAL otlp(r.payload, 'auto', 'sum') m GROUP BY ALL),
        missing AS (SELECT r.flag, r.mode AS name, sum(s.total) AS skipped, sum(r.unseen) AS unseen FROM requests r, LATERAL otlp_skipped(r.payload, 'auto') s GROUP BY ALL)
        SELECT flag, name, aggregation_temporality, n + skipped AS points, v + unseen AS total, skipped FROM points JOIN missing USING (flag, name)""")


def _logged(spark, payloads, **options) -> str:
    """Payloads written to a new log; its path."""
    payload_log.register(spark)
    path = new_folder(spark, "payload_log")
    payloads.write.format(payload_log.NAME).options(**options).mode("append").save(path)
    return path


@query(q._LOGS)
def payload_log_logs(spark, sf_dir):
    """Wire bytes through packed segments of a payload log, read in ranges of 32 KiB that begin anywhere."""
    path = _logged(spark, synth.as_format(q.log_payloads(spark, sf_dir), "logs", "protobuf"), packing="gzip")
    read = spark.read.format(payload_log.NAME).option("splitBytes", 32 << 10).load(path)
    return q._hexed(transform.transform_logs(read.select("payload_id", "payload", "format")), *q._LOG_COLUMNS)


@query("""SELECT status_code, message, count(*) AS n, coalesce(sum(CASE WHEN status_code = 0 THEN event_id % 20 END), 0)::BIGINT AS bytes FROM (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 16 WHEN event_id % 20 > 12 THEN 8 ELSE 0 END AS status_code, CASE WHEN event_id % 7 = 0 THEN 'wrong token' WHEN event_id % 20 > 12 THEN 'message is larger than 12 bytes' ELSE '' END AS message FROM events) GROUP BY ALL""")
def payload_log_admission(spark, sf_dir):
    """Messages by their status: a wrong token, too large a message, admitted."""
    events = synth.read(spark, sf_dir, "events").select(F.col("event_id").alias("payload_id"), F.repeat(F.lit("x"), (F.col("event_id") % 20).cast("int")).alias("payload"), F.when(F.col("event_id") % 7 > 0, "good").otherwise("bad").alias("token"))
    read = spark.read.format(payload_log.NAME).options(token="good", maxMessageBytes=12).load(_logged(spark, events, lane="events"))
    return read.groupBy("status_code", "message").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes"))


@query("""SELECT 'gauge' AS "table", count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events UNION ALL SELECT 'sum', count(*), sum(l_quantity::BIGINT)::BIGINT * 100 FROM lineitem""")
def table_log_metrics(spark, sf_dir):
    """Two tables in one commit, which is tried twice, read back through the manifests."""
    log = table_log.TableLog(spark, new_folder(spark, "table_log"))
    gauge = transform.transform_metrics(q.gauge_payloads(spark, sf_dir), "json").gauge.select("name", F.round(F.col("double_value") * 100).cast("bigint").alias("cents"))
    total = synth.read(spark, sf_dir, "lineitem").select(F.lit("qty").alias("name"), (F.col("l_quantity").cast("bigint") * 100).alias("cents"))
    for _ in range(2):
        log.commit({"gauge": gauge, "sum": total}, 7)
    return log.read("gauge").withColumn("table", F.lit("gauge")).unionByName(log.read("sum").withColumn("table", F.lit("sum"))).groupBy("table").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def _typed(key: str, field: str, kind: int, c) -> Column:
    value = {"kind": F.lit(kind), "str": None, "int": None, "dbl": None, "bool": None, "bytes": None, "json": None} | {field: c}
    return F.struct(F.lit(key).alias("key"), F.struct(*((F.lit(None) if v is None else v).alias(k) for k, v in value.items())).cast(ANY).alias("value"))


def typed_spans(spark, sf_dir):
    """A span an item, a trace an order, with an attribute of each kind."""
    items, orders = synth.read(spark, sf_dir, "lineitem"), synth.read(spark, sf_dir, "orders")
    attrs = F.array(_typed("flag", "str", STR, F.col("l_returnflag")), _typed("part", "int", INT, F.col("l_partkey")), _typed("price", "dbl", DOUBLE, F.col("l_extendedprice").cast("double")), _typed("open", "bool", BOOL, F.col("l_linestatus") == "O"), _typed("raw", "bytes", BYTES, F.unhex(F.md5(F.col("l_suppkey").cast("string")))))
    made = {
        "trace_id": F.md5(F.col("o_orderkey").cast("string")), "span_id": F.left(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber")), F.lit(16)), "parent_span_id": F.lit(""), "trace_state": F.lit("w=1"), "name": F.col("l_linestatus"), "kind": F.lit(2),
        "start_time_unix_nano": synth.nanos(F.col("o_orderdate")), "end_time_unix_nano": synth.nanos(F.col("l_shipdate")), "attrs": attrs, "dropped_attributes": F.col("l_linenumber"), "dropped_events": F.lit(2), "dropped_links": F.lit(3), "flags": F.lit(1),
        "status_code": F.lit(1), "status_message": F.lit(""), "resource_attrs": F.array(_typed("service.name", "str", STR, F.concat(F.lit("s-"), F.col("o_orderstatus"))), _typed("cust", "int", INT, F.col("o_custkey"))), "resource_schema_url": F.lit("r"),
        "scope_name": F.col("l_returnflag"), "scope_version": F.lit("1"), "scope_attrs": F.array(_typed("n", "int", INT, F.lit(7).cast("long"))), "scope_schema_url": F.lit(""),
    }
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*(c.alias(k) for k, c in made.items()))


@query("""SELECT md5(o_orderkey::VARCHAR) AS trace_id, left(md5(l_orderkey || '-' || l_linenumber), 16) AS span_id, l_returnflag AS flag, l_partkey::BIGINT AS part, l_extendedprice::DOUBLE AS price, l_linestatus = 'O' AS open, md5(l_suppkey::VARCHAR) AS raw,
  o_custkey::BIGINT AS cust, l_returnflag AS scope_name, 7::BIGINT AS scope_n, l_linenumber::BIGINT AS dropped_attributes, 2::BIGINT AS dropped_events, 1::INTEGER AS status_code FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def trace_responses_typed(spark, sf_dir):
    """Responses with typed attributes of span, resource and scope, read back."""
    back = trace_lookup.read_responses(trace_lookup.responses(typed_spans(spark, sf_dir)))
    of = lambda column, key, field: F.element_at(F.filter(column, lambda a: a["key"] == key), 1)["value"][field]
    text = lambda c: F.lower(F.hex(c))
    return back.select(
        text("trace_id").alias("trace_id"), text("span_id").alias("span_id"), of("attrs", "flag", "str").alias("flag"), of("attrs", "part", "int").alias("part"), of("attrs", "price", "dbl").alias("price"), of("attrs", "open", "bool").alias("open"), text(of("attrs", "raw", "bytes")).alias("raw"),
        of("resource_attrs", "cust", "int").alias("cust"), "scope_name", of("scope_attrs", "n", "int").alias("scope_n"), "dropped_attributes", "dropped_events", "status_code",
    )


@query("""SELECT status_code, status, message, count(*) AS batches FROM (
    SELECT CASE event_id % 10 WHEN 4 THEN 3 WHEN 7 THEN 8 ELSE 0 END AS status_code, CASE event_id % 10 WHEN 4 THEN 'INVALID_ARGUMENT' WHEN 7 THEN 'RESOURCE_EXHAUSTED' ELSE 'OK' END AS status,
      CASE event_id % 10 WHEN 4 THEN 'trace_id must be 16 bytes, got 0' WHEN 7 THEN 'ingest buffer full' ELSE '' END AS message FROM events WHERE event_id % 10 IN (4, 7, 9)) GROUP BY ALL""")
def star_ack_codes(spark, sf_dir):
    """A stream an event of some kinds: a span whose id is zero closes its stream, a large message finds no room, others are fine."""
    e = synth.read(spark, sf_dir, "events").where("event_id % 10 in (4, 7, 9)")
    trace = F.when(F.col("event_id") % 10 == 4, "0" * 32).otherwise(F.md5(F.col("event_id").cast("string")))
    name = F.when(F.col("event_id") % 10 == 7, F.repeat(F.lit("x"), 20_000)).otherwise(F.lit("x"))
    text = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"'), trace, F.lit('","spanId":"0102030405060708","name":"'), name, F.lit('"}]}]}]}'))
    messages = synth.star_messages(e.select(F.col("event_id").alias("payload_id"), text.cast("binary").alias("payload")), "traces", 1 << 30)
    acks = star_session.acks(star_session.outcomes(messages, "traces", budget=20_000))
    return acks.withColumn("status", status.name_of(F.col("status_code"))).groupBy("status_code", "status", "message").agg(F.count("*").alias("batches"))
