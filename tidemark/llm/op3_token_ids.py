"""Operator 3, token ids as binary: fixed-width bit packing.

Every id takes the minimum bits of its vocabulary.  A file image holds the rows'
ids, an index of document ends, and blocks of ``BLOCK`` ids that start on 8-byte
borders at listed offsets, so numpy unpacks a block at once and any id is found
without reading what stands before it.

Image: magic ``TMB1``, then little-endian uint32 width, uint32 block size, uint64
documents, uint64 ids, uint64 blocks; int64 document ids (with one validity byte
each), uint64 document ends, uint64 block offsets, payload.  Images are rows of a
Parquet table that Spark commits, so half-written files of lost tasks never show
and any Hadoop store can hold them.

Null texts are empty, so such a document is its end id alone.  Null ids are
written last; repeated rows are written each.  A text of any length is one
document of one image.  An empty table gives no images; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._vec import text_slices
from .token_memo import hf_memo

MAGIC, BLOCK = b"TMB1", 1 << 16
_HEAD = struct.Struct("<4sIIQQQ")


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids side by side, ``width`` bits each, lowest bits first, padded to whole groups of 64 ids."""
    groups = -(-len(ids) // 64)
    v = np.zeros(groups * 64, np.uint64)
    v[: len(ids)] = ids
    v = v.reshape(groups, 64)
    out = np.zeros((groups, width), "<u8")
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, word] |= v[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, i] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    groups = -(-n // 64)
    w = np.frombuffer(data, "<u8", groups * width).reshape(groups, width)
    out, mask = np.empty((groups, 64), np.uint32), np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        v = w[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (w[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = v & mask
    return out.reshape(-1)[:n]


def write_image(doc_ids: list, ends: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    n_blocks = -(-len(ids) // BLOCK)
    parts = [pack(ids[i * BLOCK : (i + 1) * BLOCK], width) for i in range(n_blocks)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))[:-1] if parts else np.zeros(0)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([_HEAD.pack(MAGIC, width, BLOCK, len(doc_ids), len(ids), n_blocks), known.tobytes(), numbers.tobytes(), ends.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *parts])


class Image:
    """Random access to an image: ``ids(first, end)`` unpacks only the blocks that hold them."""

    def __init__(self, data: bytes):
        magic, self.width, self.block, self.n_docs, self.n_ids, n_blocks = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a packed token image")
        self.data, at = memoryview(data), _HEAD.size
        known = np.frombuffer(data, np.uint8, self.n_docs, at)
        at += self.n_docs
        self.doc_ids = [int(x) if k else None for x, k in zip(np.frombuffer(data, "<i8", self.n_docs, at), known)]
        at += 8 * self.n_docs
        self.ends = np.frombuffer(data, "<u8", self.n_docs, at).astype(np.int64)
        at += 8 * self.n_docs
        self.offsets, self.payload = np.frombuffer(data, "<u8", n_blocks, at).astype(np.int64), at + 8 * n_blocks

    def ids(self, first: int, end: int) -> np.ndarray:
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (end - 1) // self.block + 1
        got = [unpack(self.data[self.payload + int(self.offsets[i]) :], min(self.block, self.n_ids - i * self.block), self.width) for i in range(a, b)]
        return np.concatenate(got)[first - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, image_ids: int = 1 << 22) -> None:
    """Encode all texts and write images in ascending id order: one range exchange, one sort within tasks, one write."""
    width = width_of(vocabulary)
    n = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    order = F.col(id_col).asc_nulls_last()
    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(n, order, F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_last(), "text")

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, parts, doc_ids, ends = TaskContext.get().partitionId(), 0, 0, [], [], []
        memo = hf_memo(tokenizer)

        def image():
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            data = write_image(doc_ids, np.array(ends, np.int64), flat, width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_docs", "n_ids", "image"])

        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(1), 1 << 21):
                ids, at = memo.texts(buf, off)
                rows = batch.column(0).slice(a, b - a).to_pylist()
                out = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
                parts.append(out)
                doc_ids += rows
                ends += (at[1:] + held).tolist()
                held += len(out)
                if held >= image_ids:
                    yield image()
                    seq, held, parts, doc_ids, ends = seq + 1, 0, [], [], []
        if doc_ids:
            yield image()

    images = ranged.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, image binary")
    images.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """Per document, from the images alone: doc_id, start, n_tokens, ids_crc32.

    The first place of each image comes from a running sum over one small row per image.
    """
    files = spark.read.parquet(path)
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", "n_ids").withColumn("first", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).drop("n_ids")

    def run(batches):
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = Image(data.as_buffer().to_pybytes())
                begin = np.concatenate(([0], x.ends[:-1])).astype(np.int64)
                flat = x.ids(0, x.n_ids).astype("<u4")
                crc = [zlib.crc32(flat[i:j]) for i, j in zip(begin.tolist(), x.ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(x.doc_ids, pa.int64()), pa.array(begin + first), pa.array(x.ends - begin), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = files.select("part", "seq", "image").join(starts, ["part", "seq"]).select("first", "image")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir):
    import uuid

    import public_tokenizers

    from ._io import folder, table

    path = f"{folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"), 49408, 1)
    return read_token_files(spark, path)
