"""Relational reconstruction of star tables: differences, attributes, children.

Keys are (stream_id, batch_id).  Ids sent as differences are running sums;
parent ids sent as differences to an equal previous row are running sums within
islands.  Windows never cross a batch, whose ids have 16 bits, so they are small.
Attributes and children attach by equi-joins on (batch, parent_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..schemas import ANY, ATTRS, EXP_HISTOGRAM, GAUGE, HISTOGRAM, IR, SUM, SUMMARY

BATCH = ["stream_id", "batch_id"]


def _rows(by: list[str]):
    return Window.partitionBy(*by).orderBy("row")


def _is_plain(c: str) -> Column:
    return F.array_contains("plain", c)


def delta(df: DataFrame, column: str, bits: int, by: list[str] = BATCH) -> DataFrame:
    """Running sum; nulls stay null and add nothing; a sum over ``bits`` is an error."""
    total = F.sum(column).over(_rows(by).rowsBetween(Window.unboundedPreceding, 0))
    over = F.raise_error(F.lit(f"{column} delta overflows")).cast("bigint")
    value = F.when(_is_plain(column) | F.col(column).isNull(), F.col(column)).when(total >= 1 << bits, over).otherwise(total)
    return df.withColumn(column, value)


def quasi_delta(df: DataFrame, same: Column, bits: int, column: str = "parent_id", by: list[str] = BATCH) -> DataFrame:
    """``same`` compares a row with the one before (see ``previous``): where it holds, the value is a difference to it."""
    w = _rows(by)
    df = df.withColumn("_same", F.coalesce(same, F.lit(False)) & (F.row_number().over(w) > 1))
    df = df.withColumn("_island", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(w))
    total = F.sum(column).over(Window.partitionBy(*by, "_island").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    over = F.raise_error(F.lit(f"{column} delta overflows")).cast("bigint")
    return df.withColumn(column, F.when(_is_plain(column), F.col(column)).when(total >= 1 << bits, over).otherwise(total)).drop("_same", "_island")


def previous(c: str, by: list[str] = BATCH) -> Column:
    return F.lag(c).over(_rows(by))


def same_attribute() -> Column:
    """Same type, key and value; empty, map and slice values, and null cells, are never the same; doubles by their bits."""
    bits = lambda c: F.when(c == 0, F.when(c.cast("string") == "-0.0", F.lit("-0")).otherwise(F.lit("0"))).otherwise(c.cast("string"))
    t = F.col("type")
    value = F.when(t == 1, F.col("str") == previous("str")).when(t == 2, F.col("int") == previous("int")).when(t == 3, bits(F.col("double")) == bits(previous("double"))).when(t == 4, F.col("bool") == previous("bool")).when(t == 7, F.col("bytes") == previous("bytes"))
    return (t == previous("type")) & (F.col("key") == previous("key")) & value


def same_cells(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(previous(c))
    return out


def any_value(prefix: str = "") -> Column:
    """A typed row of cells as a value; a null type is no value, a null cell an empty one."""
    c = lambda n: F.col(prefix + n)
    kind = c("type")
    missing = F.when(kind == 1, c("str").isNull()).when(kind == 2, c("int").isNull()).when(kind == 3, c("double").isNull()).when(kind == 4, c("bool").isNull()).when(kind.isin(5, 6), c("ser").isNull()).when(kind == 7, c("bytes").isNull()).otherwise(F.lit(False))
    return F.when(kind.isNotNull(), F.struct(F.when(missing, 0).otherwise(kind).cast("tinyint").alias("kind"), c("str").alias("str"), c("int").alias("int"), c("double").alias("dbl"), c("bool").alias("bool"), c("bytes").alias("bytes"), c("ser").alias("json")).cast(ANY))


class Star:
    """The tables of decoded star rows."""

    def __init__(self, star: DataFrame):
        self.star = star.where("error is null")

    def table(self, name: str) -> DataFrame:
        return self.star.where(F.col("table") == name)

    def attributes(self, name: str, bits: int, alias: str, sent_plain: bool = False) -> DataFrame:
        """(batch, _parent, alias): attributes of each parent in row order."""
        rows = self.table(name)
        rows = rows if sent_plain else quasi_delta(rows, same_attribute(), bits)
        pair = F.struct(F.col("row"), F.struct(F.col("key").alias("key"), any_value().alias("value")).alias("a"))
        sorted_pairs = F.array_sort(F.collect_list(pair))
        return rows.groupBy(*BATCH, F.col("parent_id").alias("_parent")).agg(F.transform(sorted_pairs, lambda x: x["a"]).cast(ATTRS).alias(alias))

    def attach(self, rows: DataFrame, side: DataFrame, key: str, alias: str, kind: str = ATTRS) -> DataFrame:
        """Left outer join by (batch, key); rows without a match get an empty list."""
        joined = rows.join(side.withColumnRenamed("_parent", "_k").withColumnsRenamed({b: f"_{b}" for b in BATCH}), (F.col("stream_id") == F.col("_stream_id")) & (F.col("batch_id") == F.col("_batch_id")) & (F.col(key) == F.col("_k")), "left")
        return joined.withColumn(alias, F.coalesce(alias, F.array().cast(kind))).drop("_k", "_stream_id", "_batch_id")

    def root(self, name: str) -> DataFrame:
        """Root rows with decoded ids, context attributes and the ordinals of groups in first-seen order."""
        rows = self.table(name)
        for c in ("id", "resource_id", "scope_id"):
            rows = delta(rows, c, 16)
        by_resource, by_scope = Window.partitionBy(*BATCH, "resource_id"), Window.partitionBy(*BATCH, "resource_id", "scope_id")
        rows = rows.withColumn("resource_ord", F.min("row").over(by_resource)).withColumn("scope_ord", F.min("row").over(by_scope))
        first = by_scope.orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("scope_name", F.first("scope_name").over(first)).withColumn("scope_version", F.first("scope_version").over(first))
        rows = self.attach(rows, self.attributes("resource_attrs", 16, "resource_attrs"), "resource_id", "resource_attrs")
        return self.attach(rows, self.attributes("scope_attrs", 16, "scope_attrs"), "scope_id", "scope_attrs")


def _present_time(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(0).cast("bigint"))


def _ir(rows: DataFrame, signal: str, cols: dict[str, Column]) -> DataFrame:
    types = T.StructType.fromDDL(IR[signal])
    cols = {"payload_id": F.col("batch_id"), "metric_ord": F.lit(0), "record_ord": F.col("row"), "error": F.lit(None)} | cols
    return rows.select("stream_id", *((cols[f.name] if f.name in cols else F.col(f.name)).cast(f.dataType).alias(f.name) for f in types))


def log_ir(star: DataFrame) -> DataFrame:
    s = Star(star)
    rows = s.attach(s.root("logs"), s.attributes("log_attrs", 16, "attrs"), "id", "attrs")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return _ir(rows, "logs", {"time": _present_time("time_unix_nano"), "observed": _present_time("observed_time_unix_nano"), "severity_number": zero("severity_number"), "body": any_value("body_"), "dropped": zero("dropped_attributes_count"), "flags": zero("flags")})


def span_ir(star: DataFrame) -> DataFrame:
    s = Star(star)
    types = {f.name: f.dataType for f in T.StructType.fromDDL(IR["traces"])}
    rows = s.attach(s.root("spans"), s.attributes("span_attrs", 16, "attrs"), "id", "attrs")

    def children(name: str, same: Column, attrs: str, alias: str, *cells: Column) -> DataFrame:
        c = quasi_delta(delta(s.table(name), "id", 32), same, 16)
        c = s.attach(c, s.attributes(attrs, 32, "attrs"), "id", "attrs")
        return c.groupBy(*BATCH, F.col("parent_id").alias("_parent")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", F.struct(*cells, F.col("attrs")).alias("x")))), lambda x: x["x"]).alias(alias))

    events = children("events", same_cells("name"), "event_attrs", "events", _present_time("time_unix_nano").alias("time"), F.coalesce("name", F.lit("")).alias("name"))
    links = children("links", same_cells("trace_id"), "link_attrs", "links", F.col("trace_id"), F.col("span_id"), F.col("trace_state"))
    rows = s.attach(s.attach(rows, events, "id", "events", types["events"]), links, "id", "links", types["links"])
    start = _present_time("start_time_unix_nano")
    # a span without a start has no end either
    end = F.when(start > 0, start + F.greatest(F.coalesce("duration_time_unix_nano", F.lit(0)), F.lit(0))).otherwise(F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = F.when(F.coalesce("has_status", F.lit(False)), zero("status_code"))
    return _ir(rows, "traces", {"start": start, "end": end, "name": F.coalesce("name", F.lit("")), "kind": zero("kind"), "status_code": status, "dropped_attributes": zero("dropped_attributes_count"), "dropped_events": zero("dropped_events_count"), "dropped_links": zero("dropped_links_count"), "flags": zero("flags")})


def point_ir(star: DataFrame) -> DataFrame:
    s = Star(star)
    types = {f.name: f.dataType for f in T.StructType.fromDDL(IR["metrics"])}
    root = s.root("metrics").select(*BATCH, F.col("id").alias("_metric"), "metric_type", F.col("row").alias("metric_row"), "resource_ord", "scope_ord", "resource_attrs", "scope_name", "scope_version", "scope_attrs", F.col("name").alias("m_name"), F.col("description").alias("m_description"), F.col("unit").alias("m_unit"), F.col("aggregation_temporality").alias("m_temporality"), F.col("is_monotonic").alias("m_monotonic"))

    def points(name: str, kinds: list[int], attrs: str | None, exemplars: str | None) -> DataFrame:
        p = delta(delta(s.table(name), "id", 32), "parent_id", 16)
        if attrs:
            p = s.attach(p, s.attributes(attrs, 32, "attrs"), "id", "attrs")
        else:
            p = p.withColumn("attrs", F.array().cast(ATTRS))
        if exemplars:
            e = quasi_delta(delta(s.table(exemplars), "id", 32), same_cells("int_value", "double_value"), 32)
            e = s.attach(e, s.attributes(exemplars.replace("exemplars", "exemplar_attrs"), 32, "attrs"), "id", "attrs")
            one = F.struct(_present_time("time_unix_nano").alias("time"), "trace_id", "span_id", "int_value", F.when(F.col("int_value").isNull(), F.col("double_value")).alias("double_value"), "attrs")
            e = e.groupBy(*BATCH, F.col("parent_id").alias("_parent")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", one.alias("x")))), lambda x: x["x"]).cast(types["exemplars"]).alias("exemplars"))
            p = s.attach(p, e, "id", "exemplars", types["exemplars"])
        else:
            p = p.withColumn("exemplars", F.array().cast(types["exemplars"]))
        # gauges and sums share a table: the metric's own type tells them apart
        m = root.where(F.col("metric_type").isin(kinds)).withColumnsRenamed({b: f"_{b}" for b in BATCH})
        for c in ("metric_type", "resource_ord", "scope_ord", "scope_name", "scope_version", "resource_attrs", "scope_attrs"):
            p = p.drop(c)
        return p.join(m, (F.col("stream_id") == F.col("_stream_id")) & (F.col("batch_id") == F.col("_batch_id")) & (F.col("parent_id") == F.col("_metric"))).drop("_stream_id", "_batch_id")

    number = points("number_points", [GAUGE, SUM], "number_attrs", "number_exemplars")
    hist = points("histogram_points", [HISTOGRAM], "histogram_attrs", "histogram_exemplars")
    exp = points("exp_points", [EXP_HISTOGRAM], "exp_attrs", "exp_exemplars")
    summary = points("summary_points", [SUMMARY], None, None)
    rows = number.unionByName(hist).unionByName(exp).unionByName(summary)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    listed = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    u64s = types["bucket_counts"]
    has = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v)
    return _ir(rows, "metrics", {
        "metric_ord": F.col("metric_row"), "shape": F.col("metric_type"), "name": F.coalesce("m_name", F.lit("")), "description": F.coalesce("m_description", F.lit("")), "unit": F.coalesce("m_unit", F.lit("")),
        "time": _present_time("time_unix_nano"), "start": _present_time("start_time_unix_nano"), "double_value": F.when(F.col("int_value").isNull(), F.col("double_value")),
        "count": zero("count"), "bucket_counts": listed("bucket_counts", u64s), "explicit_bounds": listed("explicit_bounds", types["explicit_bounds"]), "scale": zero("scale"), "zero_count": zero("zero_count"), "zero_threshold": zero("zero_threshold"),
        "positive_offset": has("has_positive", zero("positive_offset")), "positive_counts": has("has_positive", listed("positive_counts", u64s)), "negative_offset": has("has_negative", zero("negative_offset")), "negative_counts": has("has_negative", listed("negative_counts", u64s)),
        "flags": zero("flags"), "temporality": F.coalesce("m_temporality", F.lit(0)), "monotonic": F.coalesce("m_monotonic", F.lit(False)),
    })


IRS = {"logs": log_ir, "traces": span_ir, "metrics": point_ir}
