"""Tables, row references and the shared scratch folder."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of ``sf_dir``, read with Spark's reader only, so that any Hadoop path works."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset and Spark is local (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_FOLDER: ContextVar[str | None] = ContextVar("scratch folder", default=None)


def folder(spark: SparkSession) -> str:
    """Where tables are written now."""
    return _FOLDER.get() or f"{scratch_root(spark)}/tidemark"


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver's JVM for a collection, on which Spark drops the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the tables written inside, deleted at the end.

    Gives the folder around it, for the table that is to outlive the others.
    """
    outer = folder(spark)
    inner = f"{outer}/{uuid.uuid4().hex}"
    token = _FOLDER.set(inner)
    try:
        yield outer
    finally:
        _FOLDER.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inner)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        free_shuffles(spark)


def materialize(df: DataFrame, name: str, into: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = f"{into or folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): all columns but the text are one struct, so no name of theirs meets a name of ours."""
    rest = [F.col(quoted(c)) for c in docs.columns if c != text_col]
    return docs.select(F.struct(*rest).alias("row"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))


def unpacked_rows(out: DataFrame, columns: list[str], text_col: str, made: list[str]) -> DataFrame:
    """The columns of ``packed_rows`` again, then those in ``made``, which replace columns of the same name."""
    back = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns if c not in made]
    return out.select(*back, *made)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts (one cheap JVM scan)."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def buckets(total: int, each: int) -> int:
    """Number of hash buckets so that one holds about ``each`` of ``total``."""
    return max(8, math.ceil(total / each))


#: Keys of a table that a join may send to all tasks: those that hold more than a share of the rows, so few by number.
HEAVY = 1 << 14


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", least: int = 10_000) -> DataFrame:
    """Join whose ``left`` may have very many rows of a key; ``right`` has few of any.

    Keys of more than ``least`` rows and of more than one row in HEAVY (so HEAVY
    keys at most) are joined by a broadcast of their rows of ``right``; the rest
    by shuffle.  Both sides are read more than once.
    """
    total = left.count()
    if total <= least:
        return left.join(right, on, how)
    heavy = materialize(left.groupBy(*on).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max(least, total // HEAVY)).select(*on), "heavy")
    if heavy.isEmpty():
        return left.join(right, on, how)
    few = F.broadcast(heavy)
    hot = left.join(few, on, "left_semi").join(F.broadcast(right.join(few, on, "left_semi")), on, how)
    return hot.unionByName(left.join(few, on, "left_anti").join(right, on, how))


def with_ref(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``_ref``: a long that names a (id, text) pair and is ordered as the ids are, nulls last.

    Ids that are unique and not null are used as they are.  Otherwise the
    distinct pairs are sorted over the cluster and numbered; pairs of one id
    are ordered by the hash of their texts, fully repeated rows share one
    reference.
    """
    n, known, distinct = docs.agg(F.count("*"), F.count(id_col), F.count_distinct(id_col)).first()
    if n == known == distinct and dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        return docs.withColumn("_ref", F.col(id_col).cast("long"))
    keyed = docs.withColumn("_k1", F.xxhash64(text_col)).withColumn("_k2", F.xxhash64(F.lit(7), F.col(text_col)))
    pairs = keyed.select(F.col(id_col).alias("_id"), F.col("_k1").alias("_a"), F.col("_k2").alias("_b")).distinct()
    order = pairs.orderBy(F.col("_id").asc_nulls_last(), "_a", "_b").withColumn("_ref", F.monotonically_increasing_id())
    order = materialize(order, "refs")
    return keyed.join(order, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_k1") == F.col("_a")) & (F.col("_k2") == F.col("_b"))).drop("_id", "_a", "_b", "_k1", "_k2")
