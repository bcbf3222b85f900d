"""Structured Streaming: payload files to tables, and star streams with their sessions as state.

``ingest`` reads a landing folder of payload rows and writes the signal's tables
in each micro-batch, idempotent by batch id.  ``star_stream`` keeps one session
per stream in keyed state: the bytes that an IPC stream needs to go on (schemas
and dictionaries); ``ingest_star`` joins it to the sinks.  A decode error poisons a stream; later batches of it are
answered with an error and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.star import IRS
from ..plans import transform
from ..sources import sinks, wire
from ..sources.decode import decode
from ..sources.star_session import STAR, Budget, Session, refused_row, standing, star_rows, star_schema, star_table
from ..sources.table_log import TableLog
from . import status

PAYLOADS = "payload_id bigint, payload binary, format string, token string"
MAX_MESSAGE = 4 << 20
#: Acknowledgement codes.
OK, UNAUTHENTICATED, INVALID, TOO_LARGE = 0, 16, 3, 8


def read_payloads(spark: SparkSession, path: str, schema: str = PAYLOADS, max_files: int = 100) -> DataFrame:
    """A landing folder as a stream; the file limit is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def admission(payload: Column, token: Column | None = None, expected: str | None = None, max_bytes: int = MAX_MESSAGE) -> Column:
    """Acknowledgement code of a message before it is decoded."""
    code = F.when(F.octet_length(payload) > max_bytes, TOO_LARGE).otherwise(OK)
    return code if expected is None else F.when(~token.eqNullSafe(F.lit(expected)), UNAUTHENTICATED).otherwise(code)


def deliver(tables: dict[str, DataFrame], acks: DataFrame, path: str, batch_id: int, atomic: bool, answer_failures: bool = False) -> None:
    """Tables and acknowledgements of a micro-batch.

    ``atomic``: in one commit of a ``TableLog``.  Otherwise in a folder a table
    and batch, acknowledgements last: what is acknowledged is written.
    ``answer_failures`` (atomic only): a batch that cannot be written is answered
    with internal errors, of which its senders know to send again; else the query fails.
    """
    if atomic:
        log = TableLog(acks.sparkSession, path)
        try:
            log.commit(tables | {"acks": acks}, batch_id)
        except Exception:
            if not answer_failures:
                raise
            log.commit({"acks": status.after_failure(acks)}, batch_id)
    else:
        sinks.deliver(tables, path, batch_id)
        acks.write.mode("overwrite").parquet(f"{path}/acks/batch={batch_id}")


def ingest(payloads: DataFrame, signal: str, path: str, checkpoint: str, expected_token: str | None = None, fmt: str | None = None, atomic: bool = False, trigger: dict | None = None, answer_failures: bool = False):
    """Start a query that writes tables and acknowledgements below ``path``; returns the StreamingQuery.

    Where the source has admitted messages itself (columns status_code and
    message, as those of ``payload_log``), its word counts; else they are admitted here.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if atomic and TableLog(batch.sparkSession, path).committed(batch_id):
            return
        batch = batch.persist()
        try:
            code = F.col("status_code") if "status_code" in batch.columns else admission(F.col("payload"), F.col("token") if "token" in batch.columns else F.lit(None), expected_token)
            seen = batch.withColumn("_code", code).withColumn("_said", F.col("message") if "message" in batch.columns else F.lit(""))
            good = seen.where(F.col("_code") == OK).drop("_code")
            ir = decode(good, signal, fmt, whole=True).persist()  # read by the tables, the errors and the skipped points
            try:
                tables, errors, skipped = transform.tables_of(ir, signal, "permissive", whole=True)
                acks = seen.select("payload_id", "_code", "_said").join(errors, "payload_id", "left").select("payload_id", F.when(F.col("error").isNotNull(), INVALID).otherwise(F.col("_code")).alias("status_code"), F.coalesce("error", "_said", F.lit("")).alias("message"))
                deliver(tables | ({} if skipped is None else {"skipped": skipped}), acks, path, batch_id, atomic, answer_failures)
            finally:
                ir.unpersist()
        finally:
            batch.unpersist()

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def star_stream(messages: DataFrame, signal: str, budget: int | None = None) -> DataFrame:
    """Star rows of a stream of messages (stream_id, batch_id, payloads), one session per stream_id.

    ``budget``: bytes of messages that a stream may bring in a micro-batch; a
    message beyond them is answered as refused, and its stream goes on.

    State: the schema and the dictionaries of each open IPC stream, not its rows,
    so it stays as large as the dictionaries are, however long a stream is.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = star_schema()

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds, ids, records, failed = state.get if state.exists else ([], [], [], "")
        kept = {i: (kind, record) for kind, i, record in zip(kinds, ids, records)}
        session, rows, room = Session(), [], Budget(budget)
        for schema_id, (kind, record) in kept.items():
            session.restore(kind, schema_id, record)
        got = pd.concat(list(pdfs)).sort_values("batch_id")
        for batch_id, payloads in zip(got["batch_id"].tolist(), got["payloads"].tolist()):
            if failed:
                rows.append({"stream_id": key[0], "batch_id": batch_id, "error": f"stream is closed: {failed}"})
                continue
            given = [p if isinstance(p, dict) else p.asDict() for p in payloads]
            try:
                tables = session.message(signal, given)
                rows += star_rows(key[0], batch_id, tables) if room.takes(given) else [refused_row(key[0], batch_id)]
            except (wire.DecodeError, ValueError) as e:
                failed = str(e)
                rows.append({"stream_id": key[0], "batch_id": batch_id, "error": failed})
                continue
            for p in given:
                if p["schema_id"] not in kept:  # a new stream ends the older one of its type
                    kept = {i: x for i, x in kept.items() if x[0] != p["type"]}
                kept[p["schema_id"]] = (p["type"], standing(kept.get(p["schema_id"], (0, b""))[1] + p["record"]))
        state.update(([k for k, _ in kept.values()], list(kept), [r for _, r in kept.values()], failed))
        yield star_table(rows, schema).to_pandas(types_mapper=None)

    return messages.groupBy("stream_id").applyInPandasWithState(run, STAR, "kinds array<int>, ids array<string>, records array<binary>, failed string", "append", GroupStateTimeout.NoTimeout)


def ingest_star(messages: DataFrame, signal: str, path: str, checkpoint: str, budget: int | None = None, atomic: bool = False, answer_failures: bool = False):
    """Start a query from star messages to tables and acknowledgements below ``path``; returns the StreamingQuery.

    Tables carry stream_id and batch_id.  A message that cannot be decoded, or whose
    rows normalization would refuse, closes its stream; one that finds no room in
    the stream's ``budget`` is left out whole, and its stream goes on.
    """

    def write(star: DataFrame, batch_id: int) -> None:
        star = star.persist()
        try:
            ir = IRS[signal](star).persist()
            try:
                keep = [F.col("stream_id"), F.col("payload_id").alias("batch_id")]
                tables, errors, skipped = transform.tables_of(ir, signal, "permissive", keep, transform.STAR_KEYS)
                refused = errors.select("stream_id", F.col("payload_id").alias("batch_id"), "error")
                decoded = star.where("`table` in ('message', 'refused') or error is not null").select("stream_id", "batch_id", F.col("error").alias("_error"), (F.col("table") == "refused").alias("_full"))
                found = decoded.join(refused, ["stream_id", "batch_id"], "left").withColumn("_said", F.coalesce("_error", "error"))
                code = F.when(F.col("_said").isNotNull(), status.code("invalid")).when(F.col("_full"), status.code("full")).otherwise(status.code("ok"))
                acks = found.select("stream_id", "batch_id", code.alias("status_code"), F.coalesce("_said", F.when(F.col("_full"), status.words("full")), F.lit("")).alias("message"))
                deliver(tables | ({} if skipped is None else {"skipped": skipped}), acks, path, batch_id, atomic, answer_failures)
            finally:
                ir.unpersist()
        finally:
            star.unpersist()

    return star_stream(messages, signal, budget).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
