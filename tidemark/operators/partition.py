"""Grouping by service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Columns that may hold a batch's time, in order.
TIME_COLUMNS = ("time_unix_nano", "start_time_unix_nano", "timestamp")


def min_timestamp_micros(df: DataFrame) -> Column:
    """Aggregate: the smallest time in microseconds; 0 where there is none.  ``timestamp`` longs are milliseconds."""
    for name in TIME_COLUMNS:
        if name in df.columns:
            kind = df.schema[name].dataType
            low = F.min(name)
            if isinstance(kind, T.TimestampType | T.TimestampNTZType):
                return F.coalesce(F.unix_micros(low.cast("timestamp")), F.lit(0))
            if isinstance(kind, T.LongType):
                return F.coalesce(low * 1000 if name == "timestamp" else F.expr(f"min({name}) div 1000"), F.lit(0))
            break
    return F.lit(0).cast("bigint")


def group_by_service(df: DataFrame, order: list[str]) -> DataFrame:
    """service_name, service_ord (first seen by ``order``), record_count, min_timestamp_micros.

    One partial aggregation; the ordinal is a rank over one row per service.
    """
    if dict(df.dtypes).get("service_name") != "string":
        raise ValueError("a string column service_name is needed")
    groups = df.groupBy("service_name").agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("record_count"), min_timestamp_micros(df).alias("min_timestamp_micros"))
    return groups.select("service_name", (F.row_number().over(Window.orderBy("_first")) - 1).cast("bigint").alias("service_ord"), "record_count", "min_timestamp_micros")


def first_service_name(df: DataFrame, order: list[str]) -> DataFrame:
    return df.agg(F.coalesce(F.min_by("service_name", F.struct(*order)), F.lit("unknown")).alias("service_name"))


def rows_of_service(df: DataFrame, service: str) -> DataFrame:
    return df.where(F.col("service_name") == service)


def context_duplicates(df: DataFrame) -> DataFrame:
    """One row: contexts (resource and scope of each group) and how many repeat one before."""
    contexts = df.select("payload_id", "resource_ord", "scope_ord", F.xxhash64("resource_attributes", "scope_name", "scope_version", "scope_attributes").alias("h")).distinct()
    return contexts.agg(F.count("*").alias("contexts"), (F.count("*") - F.count_distinct("h")).alias("duplicates"))


def copied_bytes(df: DataFrame) -> DataFrame:
    """One row: bytes of context text that rows repeat."""
    return df.agg(*(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(f"{c}_bytes") for c in ("resource_attributes", "scope_attributes")), F.count("*").alias("rows"))
