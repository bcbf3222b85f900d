"""Operator 9, benchmark decontamination: latent semantic retrieval.

1. Document frequencies of hashed words are counted over the passages (blocks of
   ``BLOCK`` words) of all documents.
2. A randomised SVD of TF-IDF passages gives a latent basis: the range finder and
   its power iteration are one pass over the blocks of all documents and of the
   benchmark, all at weight 1 (a text counts as often as it stands there, as in the
   frequencies).  A task's partial product has a fixed size, and a core at most
   makes one; ``task_blocks`` blocks at least share one.  Sums, Gram matrices and
   rotation are taken part by part on the executors.
3. Every passage (two neighbouring blocks) of every document is compared with
   every benchmark item, longer ones in windows of at most a passage's size.  A
   window has a direction of its own, so its cosine loses nothing however many
   items there are; ``window_block`` windows are taken in a pass.  Pairs of cosine
   ``least_cosine`` or more, or of what even weights give for a window of that
   length, are candidates; two thirds of that suffice where the cosine in the
   latent basis is ``least_latent`` or more.  So are passages that hold
   ``least_words`` - 1 words of an item in a row.
4. A candidate's surroundings are checked by the longest common subsequence of
   words: ``verbatim`` of the item or more is a leak; ``paraphrase`` or more is one
   if the answer (the ``answer`` column) stands there too.  An item without an
   answer must have that share within ``tight`` times its own length.

Items of fewer than ``least_words`` words are found where all their words stand
in a row, and only there.  Null texts have no
passages; null ids and repeated rows keep a row each; an empty benchmark or an
empty table finds nothing.  A text of any length is read whole, in one task, by
passages; items of equal share are all reported.  Extra columns are kept whatever
their names, but for the three the operator adds, which replace theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._io import materialize, packed_rows, scratch, unpacked_rows
from ._vec import BYTE_LOWER, U, mix, ngrams, row_starts, text_slices, words
from .op2_license_scans import WORD

DIMS, BLOCK, RANK = 1 << 18, 24, 208
_PARTS, _COLUMNS = 256, 256
#: Entries of a random test matrix that are not zero, a row; half-precision entries of the basis are so many times the true ones.
_SIGNS, _SCALE = 8, 4096
_PART = "part int, rows binary, data binary"
#: Bytes of text whose words are hashed at a time and blocks whose signs are summed at a time, so that what is made on the way stays in the cache.
_TEXT, _SIGNED = 1 << 18, 256


def _features(buf: np.ndarray, off: np.ndarray):
    """Word hashes, feature of each word, first word of each row, first word of each block, first block of each row."""
    _, _, row, h = words(buf, off, WORD, BYTE_LOWER)
    sizes = np.diff(row)
    blocks = (sizes + BLOCK - 1) // BLOCK
    first = np.concatenate(([0], np.cumsum(blocks)))
    inside = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
    return h, (mix(h + U(9)) >> U(65 - DIMS.bit_length())).astype(np.int64), row, np.repeat(row[:-1], blocks) + inside * BLOCK, first


def _sums(table: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray | None = None, out: np.ndarray | None = None, to: np.ndarray | None = None, chunk: int = 256, most: int = 32) -> np.ndarray:
    """Sum of the table's rows (times their weight) over each stretch of ``rows``, added to the rows ``to`` of ``out``; a chunk of sums stays in the cache."""
    if out is None:
        out, to = np.zeros((len(starts), table.shape[1]), np.float32), np.arange(len(starts))
    got, total = np.empty((chunk, table.shape[1]), table.dtype), np.empty((chunk, table.shape[1]), np.float32)

    def read(r):
        x = np.take(table, r, axis=0, out=got[: len(r)], mode="clip")
        return x if weight is None else x * weight[r, None]

    size = ends - starts
    for i in np.flatnonzero(size > most).tolist():
        for a in range(starts[i], ends[i], chunk):
            out[to[i]] += read(rows[a : min(a + chunk, ends[i])]).sum(0, dtype=np.float32)
    short = np.flatnonzero((size > 0) & (size <= most))
    short = short[np.argsort(-size[short], kind="stable")]
    for i in range(0, len(short), chunk):
        o = short[i : i + chunk]
        at, left = starts[o], -size[o]
        total[: len(o)] = read(rows[at])
        for k in range(1, -int(left[0])):
            m = int(np.searchsorted(left, -k))
            total[:m] += read(rows[at[:m] + k])
        out[to[o]] += total[: len(o)]
    return out


def _kept(rows: np.ndarray, starts: np.ndarray):
    """The rows that are not 0, and first and end one of each block."""
    keep = rows != 0
    edge = np.concatenate(([0], np.cumsum(keep)))[np.append(starts, len(rows))]
    return rows[keep], edge[:-1], edge[1:]


def _blocks(batches, slot: np.ndarray, most: int = 1 << 12):
    """Rows that are not 0 of the words, and their number in each block, of about ``most`` blocks of the texts at a time."""
    held, count = [], 0

    def joined():
        f, n = (np.concatenate(x) for x in zip(*held))
        edge = np.concatenate(([0], np.cumsum(n)))
        for i in range(0, len(n), most):
            part = n[i : i + most]
            if kept := int(part.sum()):
                yield f[edge[i] : edge[i] + kept], part

    for batch in batches:
        for _, _, buf, off in text_slices(batch.column(0), _TEXT):
            _, f, _, starts, _ = _features(buf, off)
            kept, begin, end = _kept(slot[f], starts)
            held.append((kept, end - begin))
            count += len(starts)
            if count > most // 2:
                yield from joined()
                held, count = [], 0
    if held:
        yield from joined()


def _pairs(blocks: np.ndarray, first: np.ndarray):
    """Passages: each block with the next one of its row; a row of one block is one passage.  Vectors, row, first block."""
    n = np.diff(first)
    count = np.where(n > 1, n - 1, n)
    row = np.repeat(np.arange(len(n)), count)
    at = np.repeat(first[:-1], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    follows = n[row] > 1
    out = blocks[at]
    out[follows] += blocks[at[follows] + 1]
    return out, row, at


def _alike(table: np.ndarray, weight: np.ndarray, vectors: np.ndarray, feature: np.ndarray, starts: np.ndarray, first: np.ndarray, at: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Latent cosine of each passage ``w`` with ``vectors[q]``; only the blocks of those passages are projected."""
    last = np.repeat(first[1:], np.diff(first)) - 1
    need = np.zeros(len(starts), bool)
    need[at[w]] = True
    need[np.minimum(at[w] + 1, last[at[w]])] = True
    size = np.diff(np.append(starts, len(feature)))
    if not need.any():
        return np.zeros(0, np.float32)
    rows, begin, end = _kept(feature[np.repeat(need, size)], np.concatenate(([0], np.cumsum(size[need])[:-1])))
    sums = _sums(table, rows, begin, end, weight)
    place = np.cumsum(need) - 1
    out = np.zeros(len(w), np.float32)
    for i in range(0, len(w), 1 << 14):
        a = at[w[i : i + (1 << 14)]]
        v = sums[place[a]] + sums[place[np.minimum(a + 1, last[a])]] * (a < last[a])[:, None]
        out[i : i + len(a)] = np.einsum("ij,ij->i", v, vectors[q[i : i + len(a)]]) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)
    return out


def _split(matrix: np.ndarray, kind: str):
    """The rows of a matrix that are not zero, a part at a time."""
    step = len(matrix) // _PARTS
    for i in range(_PARTS):
        part = matrix[i * step : (i + 1) * step]
        rows = np.flatnonzero(part if part.ndim == 1 else part.any(axis=1))
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([rows.astype("<i4").tobytes()], pa.binary()), pa.array([part[rows].astype(kind).tobytes()], pa.binary())], ["part", "rows", "data"])


def _added(parts: DataFrame, kind: str, shape: tuple) -> DataFrame:
    """Add the tasks' matrices part by part on the executors."""
    step = shape[0] // _PARTS
    wide = np.float64 if "f" in kind else np.int64

    def add(t: pa.Table) -> pa.Table:
        got = np.zeros((step, *shape[1:]), wide)
        for r, x in zip(t["rows"], t["data"]):
            r = np.frombuffer(r.as_buffer(), "<i4")
            got[r] += np.frombuffer(x.as_buffer(), kind).reshape(len(r), *shape[1:])
        r = np.flatnonzero(got if got.ndim == 1 else got.any(axis=1))
        return pa.table({"part": t["part"].slice(0, 1), "rows": pa.array([r.astype("<i4").tobytes()], pa.binary()), "data": pa.array([got[r].astype(kind).tobytes()], pa.binary())})

    return parts.groupBy("part").applyInArrow(add, _PART)


def _whole(parts: DataFrame, kind: str, shape: tuple) -> np.ndarray:
    """The matrix of the parts; it has a fixed size at most."""
    step = shape[0] // _PARTS
    out = np.zeros(shape, kind)
    for x in parts.toLocalIterator():
        r = np.frombuffer(x.rows, "<i4")
        out[x.part * step + r] = np.frombuffer(x.data, kind).reshape(len(r), *shape[1:])
    return out


def _signs(size: int, width: int, seed: int):
    """Columns and signs of a sparse random test matrix: one in each of ``_SIGNS`` groups of columns, a row."""
    r = np.random.default_rng(seed)
    group = width // _SIGNS
    return r.integers(0, group, (size, _SIGNS), np.int16) + np.arange(_SIGNS, dtype=np.int16) * np.int16(group), r.integers(0, 2, (size, _SIGNS), np.int8) * np.float32(2) - 1


def _directions(gram: np.ndarray, cross: np.ndarray, rank: int) -> np.ndarray:
    """What takes Y = B O to the first orthonormal eigenvectors of its Nystrom form Y (O' Y)^-1 Y', from Y' Y and O' Y; directions that are not there are zero."""
    size, v = np.linalg.eigh((cross + cross.T) / 2)
    there = size > max(1e-6 * float(size[-1]), 1e-30)
    half = v[:, there] / np.sqrt(size[there])
    size, v = np.linalg.eigh(half.T @ gram @ half)
    v, size = v[:, ::-1][:, :rank], size[::-1][:rank]
    there = size > 1e-12 * max(size, default=0)
    out = np.zeros((len(gram), rank))
    out[:, : int(there.sum())] = half @ v[:, there] / np.sqrt(size[there])
    return out


def passage_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Number of blocks with each feature, over all documents, and at DIMS that of all blocks."""

    def run(batches):
        df = np.zeros(DIMS + _PARTS, np.int64)
        for batch in batches:
            for _, _, buf, off in text_slices(batch.column(0), _TEXT):
                _, f, _, starts, _ = _features(buf, off)
                if len(f):
                    block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(f))))
                    key = np.sort(block * DIMS + f)
                    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
                    df[:DIMS] += np.bincount(key % DIMS, minlength=DIMS)
                    df[DIMS] += len(starts)
        yield from _split(df, "<i8")

    shape = (DIMS + _PARTS,)
    return _whole(_added(docs.select(text_col).mapInArrow(run, _PART), "<i8", shape), "<i8", shape)


def passage_idf(docs: DataFrame, text_col: str = "text", df: np.ndarray | None = None) -> np.ndarray:
    """ln((1 + passages) / (1 + passages with the feature)), over the blocks of all documents; ``df``: their counts, where known."""
    df = passage_counts(docs, text_col) if df is None else df
    n = int(df[DIMS])
    return np.log((1 + n) / (1 + df[:DIMS])).astype(np.float32)


def latent_basis(docs: DataFrame, items: DataFrame, idf: np.ndarray, task_blocks: int, rank: int = RANK, seed: int = 7, least_df: int = 2, df: np.ndarray | None = None):
    """Right singular directions of the TF-IDF blocks of all documents and items, by a distributed randomised SVD.

    A feature of fewer than ``least_df`` blocks goes with no other, so it is in no direction.  The row of each
    feature (0: in too few blocks), each row's idf, a broadcast of the basis in half precision and what takes it to
    orthonormal directions.  ``df``: the documents' ``passage_counts``, where known.
    """
    spark = docs.sparkSession
    df = (passage_counts(docs) if df is None else df) + passage_counts(items)
    have = np.flatnonzero(df[:DIMS] >= least_df)
    slot = np.zeros(DIMS, np.int32)
    slot[have] = np.arange(1, len(have) + 1)
    size, width = -(-(len(have) + 1) // _PARTS) * _PARTS, rank + 16
    weight = np.zeros(size, np.float32)
    weight[1 : len(have) + 1] = idf[have]
    step = size // _PARTS

    def product(batches):
        """B O for the random signs O and the task's share of B = A' A, where A has the blocks as rows of length 1."""
        columns, signs = _signs(size, width, seed)
        signs *= weight[:, None]
        out = np.zeros((size, width), np.float32)
        for f, n in _blocks(batches, slot):
            block = np.repeat(np.arange(len(n)), n)
            square = np.maximum(np.bincount(block, weight[f] ** 2, len(n)), 1e-9)
            y, edge = np.empty((len(n), width), np.float32), np.concatenate(([0], np.cumsum(n)))
            for i in range(0, len(n), _SIGNED):
                j = min(i + _SIGNED, len(n))
                g = f[edge[i] : edge[j]]
                at = np.take(columns, g, axis=0) + ((block[edge[i] : edge[j]] - i) * width)[:, None]
                x = np.bincount(at.ravel(), np.take(signs, g, axis=0).ravel(), (j - i) * width).reshape(-1, width)
                np.divide(x, square[i:j, None], out=y[i:j], casting="same_kind")
            order = np.argsort(f, kind="stable")
            f = f[order]
            cut = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1], [True])))
            _sums(y, block[order], cut[:-1], cut[1:], None, out, f[cut[:-1]])
        out *= weight[:, None]
        yield from _split(out, "<f4")

    def read(batches):
        for batch in batches:
            for part, r, x in zip(*(batch.column(i) for i in range(3))):
                yield part, r, np.frombuffer(r.as_buffer(), "<i4"), np.frombuffer(x.as_buffer(), "<f4").reshape(-1, width).astype(np.float64)

    def grams(batches):
        columns, signs = _signs(size, width, seed)
        gram, cross = np.zeros((2, width, width))
        for part, _, r, y in read(batches):
            omega, r = np.zeros((len(r), width)), r + part.as_py() * step
            np.put_along_axis(omega, columns[r], signs[r], 1)
            gram += y.T @ y
            cross += omega.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([cross.tobytes()], pa.binary())], ["gram", "cross"])

    tasks = max(1, min(spark.sparkContext.defaultParallelism, int(df[DIMS]) // task_blocks))
    parts = docs.select("text").union(items.select("text")).coalesce(tasks).mapInArrow(product, _PART)
    with scratch(spark):  # the range and what it is added from go before the basis is sent
        # a few parts a task and file, for a task's rows cross to Python in one batch
        found = materialize(_added(parts.repartition(_PARTS // 8, "part"), "<f4", (size, width)), "range")
        gram, cross = np.zeros((2, width, width))
        for x in found.mapInArrow(grams, "gram binary, cross binary").toLocalIterator():
            gram += np.frombuffer(x.gram).reshape(width, width)
            cross += np.frombuffer(x.cross).reshape(width, width)
        turn = _directions(gram, cross, rank) * _SCALE

        def rotate(batches):
            for part, rows, _, y in read(batches):
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([rows.as_py()], pa.binary()), pa.array([(y @ turn).astype("<f2").tobytes()], pa.binary())], ["part", "rows", "data"])

        basis = _whole(found.mapInArrow(rotate, _PART), "<f2", (size, rank))
    return slot, weight, spark.sparkContext.broadcast(basis), np.eye(rank, dtype=np.float32) / _SCALE


def common_subsequence(masks: dict, n: int, text: list) -> int:
    """Length of the longest common subsequence; ``masks`` has the places of each word of a pattern of ``n`` words as bits."""
    full = (1 << n) - 1
    v = full
    for m in filter(None, map(masks.get, text)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def most_common(masks: dict, text: list) -> int:
    """What the longest common subsequence has at most: the words of the pattern that the text holds, and the text's that the pattern does."""
    found = [m for m in map(masks.get, text) if m]
    return min(len(found), sum(map(int.bit_count, set(found))))


def _has(part: list, whole: list) -> bool:
    n = len(part)
    return any(whole[i : i + n] == part for i in range(len(whole) - n + 1) if whole[i] == part[0]) if n else False


def _bound(n: int, paraphrase: float) -> float:
    """Cosine of a window of ``n`` words that keeps ``paraphrase`` of them with the passage that holds most of it, less a fifth for uneven weights."""
    held = n if n <= BLOCK else (n + BLOCK) / 2  # places of a window against the blocks: half of what exceeds a block may be cut off
    return 0.8 * paraphrase * held / np.sqrt(2 * BLOCK * n)


def _within(masks: dict, n: int, text: list, tight: float, least: float) -> bool:
    """Whether ``least`` of the pattern is a common subsequence with a stretch of ``tight`` times its length."""
    step = max(1, n // 16)
    width = int(tight * n) + step - 1  # holds any stretch of that length
    known = [0]
    for w in text:
        known.append(known[-1] + (w in masks))
    for i in range(0, max(1, len(text) - width + step), step):
        j = min(len(text), i + width)
        if known[j] - known[i] >= least * n and common_subsequence(masks, n, text[i:j]) >= least * n:
            return True
    return False


class Items:
    """A block of the benchmark, as the tasks use it."""

    def __init__(self, rows: list, idf: np.ndarray, slot: np.ndarray, wide: np.ndarray, least_words: int, least_cosine: float, paraphrase: float):
        self.ids, self.words, self.answers, self.masks = [], [], [], []
        vectors, of, bounds = [], [], []
        grams: dict[int, dict[int, set[int]]] = {}
        for item, text, answer in rows:
            h, f = self.read(text)
            if not h:
                continue
            q, n = len(self.ids), min(len(h), max(1, least_words - 1))
            masks: dict = {}
            for i, w in enumerate(h):
                masks[w] = masks.get(w, 0) | 1 << i
            self.ids.append(item)
            self.words.append(h)
            self.masks.append(masks)
            self.answers.append(self.read(answer)[0] if answer else [])
            for g in ngrams(np.array(h, U), n).tolist():
                grams.setdefault(n, {}).setdefault(g, set()).add(q)
            if len(h) < least_words:
                continue
            for w in np.array_split(f, -(-len(h) // (2 * BLOCK))):
                kept, count = np.unique(w, return_counts=True)
                v = idf[kept] * count
                vectors.append((kept, v / max(float(np.linalg.norm(v)), 1e-9)))
                of.append(q)
                bounds.append(min(least_cosine, _bound(len(w), paraphrase)))
        self.tables = [self.columns(vectors[i : i + _COLUMNS], idf) for i in range(0, len(vectors), _COLUMNS)]
        v = np.array([v @ wide[slot[kept]].astype(np.float32) for kept, v in vectors], np.float32).reshape(len(vectors), wide.shape[1])
        self.latent = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        self.of, self.bounds = np.array(of, np.int64), np.array(bounds, np.float32)
        self.grams = []
        for n, found in grams.items():
            seen = np.zeros(1 << 20, bool)
            seen[np.array(list(found), U) >> U(44)] = True
            self.grams.append((n, seen, found))

    @staticmethod
    def columns(vectors: list, idf: np.ndarray):
        """Row of each feature (0: in no window) and the weights of the features for each window."""
        have = np.unique(np.concatenate([kept for kept, _ in vectors]))
        slot = np.zeros(len(idf), np.int32)
        slot[have] = np.arange(1, len(have) + 1)
        out = np.zeros((len(have) + 1, len(vectors)), np.float32)
        for j, (kept, v) in enumerate(vectors):
            out[slot[kept], j] = v * idf[kept]
        return slot, out

    def cosines(self, f: np.ndarray, starts: np.ndarray, at: np.ndarray, follows: np.ndarray, square: np.ndarray, chunk: int = 1024):
        """(first window, first passage, cosines of some passages with the windows of a table); ``square`` has their squared lengths."""
        norm = np.sqrt(np.maximum(square, 1e-9)).astype(np.float32)
        for k, (slot, table) in enumerate(self.tables):
            sums = _sums(table, *_kept(slot[f], starts))
            for i in range(0, len(at), chunk):
                a = at[i : i + chunk]
                p = sums[a]
                p += sums[np.minimum(a + 1, len(sums) - 1)] * follows[i : i + chunk, None]
                p /= norm[i : i + chunk, None]
                yield k * _COLUMNS, i, p

    def verbatim(self, h: np.ndarray, row: np.ndarray):
        """(place, item) of the words in a row that an item has too."""
        for n, seen, found in self.grams:
            if len(h) >= n:
                g = ngrams(h, n)
                at = np.flatnonzero(seen[g >> U(44)] & row_starts(row, n))
                for i, x in zip(at.tolist(), g[at].tolist()):
                    for q in found.get(x, ()):
                        yield i, q

    @staticmethod
    def read(text: str):
        b = np.frombuffer((text or "").encode(), np.uint8)
        h, f, *_ = _features(b, np.array([0, len(b)]))
        return h.tolist(), f


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least_cosine: float = 0.3, verbatim: float = 0.8, paraphrase: float = 0.6, tight: float = 1.25, least_words: int = 8, task_blocks: int = 1 << 20, window_block: int = 256, least_latent: float = 0.8) -> DataFrame:
    """``docs`` plus _items (array of leaked item ids), _lcs (largest share of an item found) and _candidates (pairs checked)."""
    spark = docs.sparkSession
    given, docs = docs.columns, packed_rows(docs, id_col, text_col).drop("id")
    texts = docs.select("text")
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"), answer.alias("answer")).where("text is not null")
    n_words = F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    n_windows = int(items.agg(F.coalesce(F.sum(F.ceil(n_words / (2 * BLOCK))), F.lit(0))).first()[0])
    df = passage_counts(texts)
    idf = passage_idf(texts, df=df)
    place, columns = 1, ["row", "text"]
    out = docs.withColumns({"_items": F.array().cast("array<long>"), "_lcs": F.lit(0.0), "_candidates": F.lit(0).cast("long")})
    blocks = 1 if n_windows <= window_block else -(-n_windows * 5 // (window_block * 4))
    slot, weight, wide, _ = latent_basis(texts, items, idf, task_blocks, df=df)
    known = spark.sparkContext.broadcast((idf, slot, weight))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast([tuple(x) for x in part.orderBy("item", "text").collect()])

        def run(batches, sent=sent):
            idf, slot, weight = known.value
            bench = Items(sent.value, idf, slot, wide.value, least_words, least_cosine, paraphrase)
            for batch in batches:
                for a, b, buf, off in text_slices(batch.column(place), _TEXT):
                    n = b - a
                    old = batch.column(len(columns)).slice(a, n).to_pylist()
                    found = [set(x) for x in old]
                    lcs = batch.column(len(columns) + 1).slice(a, n).to_numpy(zero_copy_only=False).copy()
                    tried = batch.column(len(columns) + 2).slice(a, n).to_numpy(zero_copy_only=False).copy()
                    h, f, row, starts, first = _features(buf, off)
                    if len(h) and bench.ids:
                        square, of, at = _pairs(np.add.reduceat(idf[f] ** 2, starts), first)
                        pairs, close = set(), []
                        follows = (np.diff(first) > 1)[of]
                        for k, i, p in bench.cosines(f, starts, at, follows, square):
                            least = bench.bounds[k : k + p.shape[1]]
                            w, q = np.divmod(np.flatnonzero(p >= least * np.float32(2 / 3)), p.shape[1])
                            sure = p[w, q] >= least[q]
                            w += i
                            pairs.update(zip(of[w[sure]].tolist(), bench.of[q[sure] + k].tolist(), starts[at[w[sure]]].tolist()))
                            close.append((w[~sure], q[~sure] + k))
                        if close:
                            w, q = (np.concatenate(x) for x in zip(*close))
                            ok = _alike(wide.value, weight, bench.latent, slot[f], starts, first, at, w, q) >= least_latent
                            pairs.update(zip(of[w[ok]].tolist(), bench.of[q[ok]].tolist(), starts[at[w[ok]]].tolist()))
                        for i, q in bench.verbatim(h, row):
                            r = int(np.searchsorted(row, i, "right")) - 1
                            if bench.ids[q] not in found[r] or len(bench.words[q]) >= least_words:
                                pairs.add((r, q, i - (i - int(row[r])) % BLOCK))
                        done = {}
                        for r, q, place_of in sorted(pairs):
                            size = len(bench.words[q])
                            more = size // 4 if size > 4 * BLOCK else 0  # long items: what follows so soon has been looked at
                            if bench.ids[q] in found[r] or place_of - done.get((r, q), -size) < more:
                                continue
                            done[r, q] = place_of
                            tried[r] += 1
                            lo = max(int(row[r]), place_of - size)
                            near = h[lo : min(int(row[r + 1]), place_of + 2 * BLOCK + size + more)].tolist()
                            if size < least_words and not _has(bench.words[q], near):
                                continue
                            most = most_common(bench.masks[q], near) / size
                            if most <= lcs[r] and most < min(verbatim, paraphrase):
                                continue  # no leak, and no larger share than what is known
                            share = common_subsequence(bench.masks[q], size, near) / size
                            lcs[r] = max(lcs[r], share)
                            if share >= verbatim or share >= paraphrase and (_has(bench.answers[q], near) if bench.answers[q] else _within(bench.masks[q], size, near, tight, paraphrase)):
                                found[r].add(bench.ids[q])
                    made = [pa.array([sorted(x) for x in found], pa.list_(pa.int64())), pa.array(lcs, pa.float64()), pa.array(tried, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(a, n) for j in range(len(columns))), *made], [*columns, "_items", "_lcs", "_candidates"])

        out = out.mapInArrow(run, out.schema)
    return unpacked_rows(out, given, text_col, ["_items", "_lcs", "_candidates"])


def query(spark, sf_dir):
    """doc_id, n_items, item_ids, lcs_share, n_candidates, leaked of all documents against the whole benchmark."""
    from ._io import table

    found = find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("item_ids"), F.col("_lcs").alias("lcs_share"), F.col("_candidates").alias("n_candidates"), (F.size("_items") > 0).alias("leaked"))
