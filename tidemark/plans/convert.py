"""Job: payload files to Parquet, one folder per table.

    python -m tidemark.plans.convert SIGNAL IN OUT [FORMAT]

A file is one payload; many files are read by many tasks.  Bad files are listed
in ``OUT/errors`` with their path, the others are converted.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import sinks
from ..sources.decode import decode
from . import observe, transform


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(payload_id, payload, path); an id is the file's path, hashed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.xxhash64("path").alias("payload_id"), F.col("content").alias("payload"), "path")


def convert(spark: SparkSession, signal: str, path: str, out: str, fmt: str | None = "protobuf", pattern: str = "*", observer: observe.Observer | None = None) -> dict[str, int]:
    """Write the signal's tables below ``out``; returns rows written a table, bad files (``errors``) and, for metrics, skipped points by reason."""
    files = read_files(spark, path, pattern)
    ir = decode(files, signal, fmt).persist()
    try:
        with observe.phase(observer, signal, f"{fmt or 'auto'}_decode"):
            ir.count()
        tables, errors, skipped = transform.tables_of(ir, signal, "permissive")
        found = {}
        for name, table in tables.items():
            table, seen = observe.observed(table)
            with observe.phase(observer, signal, "deliver"):
                sinks.write_parquet(table, f"{out}/{name}")
            found[name] = seen.get["output_rows"]
        bad = errors.join(files.select("payload_id", "path"), "payload_id").select("path", "error")
        bad.write.parquet(f"{out}/errors")
        found["errors"] = spark.read.parquet(f"{out}/errors").count()
        return found | (skipped.first().asDict() if skipped is not None else {})
    finally:
        ir.unpersist()


if __name__ == "__main__":
    print(convert(SparkSession.builder.getOrCreate(), *sys.argv[1:5]))
