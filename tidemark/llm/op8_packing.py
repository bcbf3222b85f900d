"""Operator 8, packing: bounded-space online packing.

Each partition keeps at most ``open_windows`` open sequences.  A document's full
sequences are cut off first; the rest goes to the open sequence it fits best.
Where none fits and all are open, the fullest is topped up with a cut of the
document and emitted.  At a partition's end its open sequences are poured
together, so at most one partial sequence leaves it; partial sequences of
``FAN_IN`` partitions at a time are merged in one task each, and the one that
may be left there is padded.  Memory is bounded by the open sequences.

Null texts are empty: such a document is its end id alone.  Null ids, repeated
rows and ties are packed as rows of their own.  A text of any length is cut into
full sequences as it comes.  An empty table gives no pieces; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._io import materialize
from ._vec import text_slices
from .token_memo import hf_memo

FAN_IN = 256
_COLS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_TYPES = [pa.int64()] * 7


class Packer:
    """A piece is (document, start, ids, tokens of the document)."""

    def __init__(self, size: int, open_windows: int, first_id: int):
        self.size, self.most, self.next = size, open_windows, first_id
        self.free: list[tuple[int, int]] = []  # (free places, window), ascending
        self.held: dict[int, list] = {}
        self.done: list[list] = [[] for _ in _COLS]
        self.opened = 0

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, n in pieces:
            for col, v in zip(self.done, (doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), n, self.next, at)):
                col.append(v)
            at += len(ids)
        self.next += 1

    def _put(self, k: int, piece) -> None:
        free, w = self.free.pop(k)
        self.held[w].append(piece)
        free -= len(piece[2])
        if free:
            insort(self.free, (free, w))
        else:
            self._emit(self.held.pop(w))

    def add(self, doc, start: int, ids: np.ndarray, n: int) -> None:
        while len(ids) >= self.size:
            self._emit([(doc, start, ids[: self.size], n)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            k = bisect_left(self.free, (len(ids), -1))
            if k < len(self.free):
                self._put(k, (doc, start, ids, n))
                return
            if len(self.free) < self.most:
                self.opened += 1
                self.held[self.opened] = []
                insort(self.free, (self.size, self.opened))
                continue
            cut = self.free[0][0]
            self._put(0, (doc, start, ids[:cut], n))
            start, ids = start + cut, ids[cut:]

    def leftovers(self) -> list:
        """Pour the open sequences together; return the pieces of the partial one."""
        rest = [p for _, w in self.free for p in self.held[w]]
        self.free, self.held = [], {}
        now, room = [], self.size
        for doc, start, ids, n in rest:
            while len(ids) >= room:
                now.append((doc, start, ids[:room], n))
                self._emit(now)
                start, ids, now, room = start + room, ids[room:], [], self.size
            if len(ids):
                now.append((doc, start, ids, n))
                room -= len(ids)
        return now

    def take(self) -> list[pa.Array]:
        out = [pa.array(c, t) for c, t in zip(self.done, _TYPES)]
        self.done = [[] for _ in _COLS]
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 1024, open_windows: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    fields = ", ".join(f"{c} long" for c in _COLS)

    def run(batches):
        from pyspark import TaskContext

        part, memo = TaskContext.get().partitionId(), hf_memo(tokenizer)
        packer = Packer(size, open_windows, part << 36)

        def rows(group, ids):
            cols = packer.take() if group is None else [pa.array(c, t) for c, t in zip(zip(*((d, s, len(i), 0, n, 0, 0) for d, s, i, n in ids)), _TYPES)]
            n = len(cols[0])
            return pa.RecordBatch.from_arrays([*cols, pa.array([group] * n, pa.int64()), pa.array([None] * n if group is None else [i.astype("<u4").tobytes() for _, _, i, _ in ids], pa.binary())], [*_COLS, "merge", "ids"])

        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(1), 1 << 21):
                ids, at = memo.texts(buf, off)
                ids = np.insert(ids, at[1:], end_id).astype(np.uint32)
                at = (at + np.arange(len(at))).tolist()
                for doc, i, j in zip(batch.column(0).slice(a, b - a).to_pylist(), at, at[1:]):
                    packer.add(doc, 0, ids[i:j], j - i)
                if packer.done[0]:
                    yield rows(None, None)
        rest = packer.leftovers()
        if packer.done[0]:
            yield rows(None, None)
        if rest:
            yield rows(part // FAN_IN, rest)

    placed = materialize(picked.mapInArrow(run, f"{fields}, merge long, ids binary"), "pieces")

    def merge(t: pa.Table) -> pa.Table:
        group = t["merge"][0].as_py()
        packer = Packer(size, open_windows, (1 << 62) + (group << 36))
        for doc, start, n, data in sorted(zip(*(t[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))), key=lambda x: (-len(x[3]), x[0] is None, x[0] or 0, x[1])):
            packer.add(doc, start, np.frombuffer(data, "<u4"), n)
        packer._emit(packer.leftovers())
        return pa.Table.from_arrays(packer.take(), _COLS)

    merged = placed.where("merge is not null").groupBy("merge").applyInArrow(merge, fields)
    return placed.where("merge is null").select(*_COLS).unionByName(merged)


def query(spark, sf_dir):
    import public_tokenizers

    from ._io import table

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), 0)
