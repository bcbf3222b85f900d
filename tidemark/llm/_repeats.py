"""Which windows of ``length`` units (bytes or words) stand elsewhere: the distributed frame of operators 5 and 6.

1. ``mark``: each window has an anchor, the leftmost smallest of its k-gram
   hashes (winnowing), so equal windows have equal anchors at equal places.  The
   consecutive windows of one anchor are a segment.  A task packs its segments
   (anchor hash, row, content hash, place) by hash bucket; segments of equal
   content within the task become one with a flag, so a passage that a third of
   all rows share sends one row a task.
2. ``wanted``: a bucket finds anchors that are there twice; each distinct
   content of such an anchor is one string, with its first place as witness.
3. ``fetch``: the witnesses' contents are read from their texts.
4. ``solve``: a shard of strings is solved by the operator's own structure
   (enhanced suffix array, suffix automaton), which tells for each string which
   of its windows are repeated.
5. ``apply``: the verdicts go back to all places of each string, then to texts.

The two exchanges that carry weight (packed segments by bucket, texts by
reference) are each read twice in the plan and reused.  A bucket's size is set
from the bytes of all texts, so their number grows with the input; its strings
are solved in ``SHARDS`` shards.  An anchor that stands in very many different
contents (the edge of a passage that many rows share) would gather all of them
in one task: such anchors are found first, and their windows are dealt one by
one, by their own content (``hot_anchors``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._io import buckets, materialize, text_bytes
from ._vec import ROLL, SLICE, U, mix, ngrams, powers, row_starts, runs, sliding_argmin, text_slices, window_hash, words

FLUSH = 1_500_000
#: Different contents of an anchor from which its windows are dealt one by one, one content in SAMPLE looked at, and the most such anchors (64 MB when sent to tasks).
HOT, SAMPLE, HOT_MOST = 8192, 64, 1 << 23
#: Bytes of text a bucket stands for, and shards of strings in a bucket.
BUCKET, SHARDS = 16 << 20, 8
_ANCHOR = [("h", "<u8"), ("r", "<i8"), ("c", "<u8"), ("lo", "<u4"), ("n", "<u2"), ("m", "u1")]
_DONE = [("dr", "<i8"), ("dlo", "<u4"), ("dn", "<u4")]


@dataclass(frozen=True)
class Units:
    """How texts become units: ``byte`` or ``word``."""

    kind: str
    length: int
    k: int

    def read(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash values of all units, and each row's first unit (n + 1)."""
        if self.kind == "byte":
            return ROLL[buf], off
        _, _, row, h = words(buf, off)
        return h, row

    def raw(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units as they are shipped: bytes, or word hashes."""
        return (buf, off) if self.kind == "byte" else self.read(buf, off)

    def segments(self, buf: np.ndarray, off: np.ndarray, hot: np.ndarray | None = None):
        """Row, anchor hash, content hash, first window (in its row), windows of each segment.

        The windows of an anchor in ``hot`` (sorted) are segments of their own,
        and each one's own content takes the place of the anchor.
        """
        v, row = self.read(buf, off)
        if len(v) < self.length:
            return None
        sums = np.zeros(len(v) + 1, U)
        np.cumsum(v * powers(len(v) + 1)[0][:-1], out=sums[1:])
        if self.kind == "byte":
            g = mix((sums[self.k :] - sums[: -self.k]) * powers(len(v) + 1)[1][: len(v) - self.k + 1])
        else:
            g = ngrams(v, self.k)
        at = np.flatnonzero(row_starts(row, self.length))
        if not len(at):
            return None
        a = sliding_argmin(g, self.length - self.k + 1)[at]
        r = np.searchsorted(row, at, "right") - 1
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (r[1:] != r[:-1]))))
        n = np.diff(np.append(first, len(at)))
        lo, r, h = at[first], r[first], g[a[first]]
        split = np.zeros(len(h), bool)
        if hot is not None and len(hot):
            split = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        if split.any():
            each = n[split]
            one = np.repeat(lo[split] - np.cumsum(each) + each, each) + np.arange(each.sum())
            own = mix(window_hash(sums, one, one + self.length) + U(0xD6E8FEB86659FD93))
            r, h = np.concatenate((r[~split], np.repeat(r[split], each))), np.concatenate((h[~split], own))
            lo, n = np.concatenate((lo[~split], one)), np.concatenate((n[~split], np.ones(len(one), n.dtype)))
        return r, h, window_hash(sums, lo, lo + n - 1 + self.length), lo - row[r], n


def _sampled(units: Units):
    """(anchor, content) of one content in ``SAMPLE``."""

    def run(batches):
        for batch in batches:
            for _, _, buf, off in text_slices(batch.column(0)):
                if (got := units.segments(buf, off)) is not None:
                    pick = mix(got[2]) >> U(64 - SAMPLE.bit_length() + 1) == 0
                    pairs = np.unique(np.column_stack((got[1][pick], got[2][pick])), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], ["h", "c"])

    return run, "h long, c long"


def hot_anchors(docs: DataFrame, units: Units, text: str, total: int, hot: int) -> np.ndarray:
    """Anchors that stand in about ``hot`` different contents or more, sorted; HOT_MOST of them at most.

    The contents are sampled by their hash, so all places of a content count as
    one.  Where more anchors are that common, the bound doubles until
    they fit: it stays below twice the total of contents over HOT_MOST.  What is found
    decides only how work is split, never a result.
    """
    if total < hot * units.length:
        return np.zeros(0, U)
    run, schema = _sampled(units)
    counted = docs.select(text).mapInArrow(run, schema).distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, hot // SAMPLE))
    counted = materialize(counted, "anchors")
    least = max(2, hot // SAMPLE)
    while counted.where(F.col("n") >= least).count() > HOT_MOST:
        least *= 2
    return np.sort(counted.where(F.col("n") >= least).select("h").toArrow()["h"].to_numpy().view(U))


def _bucket(h: np.ndarray, count: int) -> np.ndarray:
    """Anchors are minima, so they are mixed first."""
    return ((mix(h + U(0x632BE59BD9B4E019)) >> U(32)) * U(count)) >> U(32)


def merge_ranges(r: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [lo, lo + n) of rows ``r``, sorted; those that touch are joined."""
    order = np.lexsort((lo, r))
    r, lo, end = r[order], lo[order].astype(np.int64), (lo + n)[order].astype(np.int64)
    if not len(r):
        return r, lo, end
    # ends never decrease within a row here but for overlaps, so a running maximum settles them
    base = np.concatenate(([0], np.cumsum(r[1:] != r[:-1]))) * (1 << 40)
    top = np.maximum.accumulate(end + base)
    new = np.concatenate(([True], (lo + base)[1:] > top[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(r)) - 1
    return r[first], lo[first], (top - base)[last] - lo[first]


def _sorted_groups(cols: dict[str, np.ndarray], once: bool):
    """Order by (h, c, r, lo), and the starts of the (h, c) groups; ``once``: a place that comes again is one."""
    order = np.lexsort((cols["lo"], cols["r"], cols["c"], cols["h"]))
    cols = {k: v[order] for k, v in cols.items()}
    if not len(cols["h"]):
        return cols, np.zeros(0, np.int64)
    differ = lambda *keys: np.concatenate(([True], np.logical_or.reduce([cols[k][1:] != cols[k][:-1] for k in keys])))
    if once:
        new = differ("h", "c", "r", "lo")
        cols = {k: v[new] for k, v in cols.items()}
    return cols, np.flatnonzero(differ("h", "c"))


def _load(table: pa.Table | list, spec) -> dict[str, np.ndarray]:
    out = {}
    for name, kind in spec:
        parts = [np.frombuffer(x.as_buffer(), kind) for x in table[name] if x.is_valid]
        out[name] = np.concatenate(parts) if parts else np.zeros(0, kind)
    return out


def _doubled(h: np.ndarray, m: np.ndarray | None = None) -> np.ndarray:
    """Mask of the items whose hash is there twice, or whose flag says so."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out if m is None else out | (m > 1)


def _mark(units: Units, count: int, once: bool, hot):
    names = ["bucket", *(x for x, _ in _ANCHOR), *(x for x, _ in _DONE)]

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        cols = {name: np.concatenate([x[i] for x in held]).astype(kind) for i, (name, kind) in enumerate(_ANCHOR[:5])}
        cols["m"] = np.ones(len(cols["h"]), np.uint8)
        two = _doubled(cols["h"])
        some, first = _sorted_groups({k: v[two] for k, v in cols.items()}, once)
        done = {"dr": np.zeros(0, np.int64), "dlo": np.zeros(0, np.int64), "dn": np.zeros(0, np.int64)}
        if len(first):
            some["m"][first] = np.minimum(np.diff(np.append(first, len(some["h"]))), 2)
            rest = np.ones(len(some["h"]), bool)
            rest[first] = False
            # equal contents beyond the first: settled, for one more stands before them
            done = dict(zip(done, merge_ranges(some["r"][rest], some["lo"][rest].astype(np.int64), some["n"][rest].astype(np.int64))))
            some = {k: v[first] for k, v in some.items()}
        cols = {k: np.concatenate((v[~two], some[k])) for k, v in cols.items()}
        b = _bucket(cols["h"], count)
        order = np.argsort(b, kind="stable")
        cols, b = {k: v[order] for k, v in cols.items()}, b[order]
        db = _bucket(done["dr"].astype(U), count)
        order = np.argsort(db, kind="stable")
        done, db = {k: v[order] for k, v in done.items()}, db[order]
        ids = np.union1d(b, db)
        cut, dcut = ((np.searchsorted(x, ids), np.searchsorted(x, ids, "right")) for x in (b, db))
        arrays = [pa.array(ids.astype(np.int64), pa.int32())]
        arrays += [pa.array([cols[k][i:j].astype(t).tobytes() for i, j in zip(*map(np.ndarray.tolist, cut))], pa.binary()) for k, t in _ANCHOR]
        arrays += [pa.array([done[k][i:j].astype(t).tobytes() for i, j in zip(*map(np.ndarray.tolist, dcut))], pa.binary()) for k, t in _DONE]
        for i in range(0, len(ids), 64):
            yield pa.RecordBatch.from_arrays([x.slice(i, 64) for x in arrays], names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ref = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, buf, off in text_slices(batch.column(1)):
                if (got := units.segments(buf, off, hot.value)) is None:
                    continue
                r, h, c, lo, n = got
                held.append((h, ref[a:b][r], c, lo, n))
                size += len(h)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run, "bucket int, " + ", ".join(f"{x} binary" for x, _ in [*_ANCHOR, *_DONE])


def _wanted(t: pa.Table, several: bool) -> pa.Table:
    cols = _load(t, _ANCHOR)
    keep = _doubled(cols["h"], cols["m"])
    cols, first = _sorted_groups({k: v[keep] for k, v in cols.items()}, False)
    m = np.add.reduceat(cols["m"].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    if several and len(first):  # anchors of one content hold nothing to compare
        h = cols["h"][first]
        other = np.concatenate(([False], h[1:] == h[:-1]))
        other[:-1] |= h[1:] == h[:-1]
        first, m = first[other], m[other]
    pick = lambda k, kind: pa.array(cols[k][first].astype(kind) if k not in "hc" else cols[k][first].view(np.int64))
    return pa.table({"ref": pick("r", np.int64), "h": pick("h", None), "c": pick("c", None), "lo": pick("lo", np.int32), "n": pick("n", np.int32), "m": pa.array(np.minimum(m, 2).astype(np.int32))})


def _fetch(units: Units, count: int, place: int):
    """Rows (shard, h, c, ref, lo, n, m, content) of the segments asked for; columns: ..., text at ``place``, want last."""

    def run(batches):
        for batch in batches:
            want = batch.column(batch.num_columns - 1)
            for a, b, buf, off in text_slices(batch.column(place)):
                part = want.slice(a, b - a)
                v, row = units.raw(buf, off)
                base = np.repeat(row[:-1], part.value_lengths().to_numpy(zero_copy_only=False))
                x = part.flatten()
                get = lambda k: x.field(k).to_numpy(zero_copy_only=False)
                at = base + get("lo")
                end = at + get("n") - 1 + units.length
                raw, size = v.tobytes(), v.itemsize
                content = [raw[i * size : j * size] for i, j in zip(at.tolist(), end.tolist())]
                shard = _bucket(get("h").view(U), count).astype(np.int32)
                for i in range(0, len(content), 4096):
                    j = slice(i, i + 4096)
                    yield pa.RecordBatch.from_arrays([pa.array(shard[j]), *(x.field(k).slice(i, 4096) for k in ("h", "c", "ref", "lo", "n", "m")), pa.array(content[j], pa.binary())], ["shard", "h", "c", "ref", "lo", "n", "m", "content"])

    return run, "shard int, h long, c long, ref long, lo int, n int, m int, content binary"


def _solved(solve: Callable):
    """One row per shard: hashes, contents and window masks of the strings that have repeated windows.

    Only strings of one anchor are compared, so a shard is solved in slices of
    whole anchors of about SLICE bytes.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        cols = {k: t[k].to_numpy() for k in ("h", "c", "ref", "lo", "n", "m")}
        order = np.lexsort((cols["lo"], cols["ref"], cols["h"]))
        same = np.logical_and.reduce([cols[k][order][1:] == cols[k][order][:-1] for k in ("h", "ref", "lo")])
        order = order[np.concatenate(([True], ~same))]  # rows that were there again
        cols = {k: v[order] for k, v in cols.items()}
        size = np.cumsum(pc.binary_length(t["content"]).to_numpy()[order].astype(np.int64))
        heads = np.append(np.flatnonzero(np.concatenate(([True], cols["h"][1:] != cols["h"][:-1]))), len(order))
        hits, data, i = [], [], 0
        while i < len(order):
            full = int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE, "right"))
            j = int(heads[max(np.searchsorted(heads, full, "right") - 1, np.searchsorted(heads, i, "right"))])
            masks = solve({k: v[i:j] for k, v in cols.items()}, t["content"].take(pa.array(order[i:j])).to_pylist())
            hit = [k for k, x in enumerate(masks) if x is not None and x.any()]
            hits.extend(i + k for k in hit)
            data.extend(np.packbits(np.append(masks[k], False)).tobytes() for k in hit)
            i = j
        return pa.table({"bucket": pa.array([t["shard"][0].as_py() // SHARDS], pa.int32()), "h": [cols["h"][hits].tobytes()], "c": [cols["c"][hits].tobytes()], "n": [cols["n"][hits].astype("<i4").tobytes()], "masks": [b"".join(data)]}, schema=pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("c", pa.binary()), ("n", pa.binary()), ("masks", pa.binary())]))

    return run, "bucket int, h binary, c binary, n binary, masks binary"


def _verdict_runs(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of the string, first window and windows of each run of repeated windows."""
    x = _load(right, [("h", "<u8"), ("c", "<u8"), ("n", "<i4"), ("masks", "u1")])
    wide = (x["n"].astype(np.int64) + 8) // 8 * 8  # each mask ends with a zero at least
    stops = np.cumsum(wide)
    starts, ends = runs(np.unpackbits(x["masks"]).astype(bool))
    string = np.searchsorted(stops, starts, "right")
    key = mix(x["h"]) ^ x["c"]
    return key[string], starts - (stops - wide)[string], ends - starts


def _applied(first_stays: bool):
    """Ranges of repeated windows per row, from a bucket's places and its verdicts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        done = _load(left, _DONE)
        r, lo, n = [done["dr"]], [done["dlo"].astype(np.int64)], [done["dn"].astype(np.int64)]
        cols = _load(left, _ANCHOR)
        keep = _doubled(cols["h"], cols["m"])
        cols, first = _sorted_groups({k: v[keep] for k, v in cols.items()}, first_stays)
        if len(first):
            size = np.diff(np.append(first, len(cols["h"])))
            if first_stays:  # every further place of a string repeats its first one whole
                rest = np.ones(len(cols["h"]), bool)
                rest[first] = False
                r.append(cols["r"][rest])
                lo.append(cols["lo"][rest].astype(np.int64))
                n.append(cols["n"][rest].astype(np.int64))
                size = np.ones(len(first), np.int64)
            if right.num_rows:
                key, begin, many = _verdict_runs(right)
                own = mix(cols["h"][first]) ^ cols["c"][first]
                order = np.argsort(own)
                group = order[np.minimum(np.searchsorted(own, key, sorter=order), len(own) - 1)]
                there = own[group] == key
                group, begin, many = group[there], begin[there], many[there]
                each = size[group]
                place = np.repeat(first[group] - np.cumsum(each) + each, each) + np.arange(each.sum())
                r.append(cols["r"][place])
                lo.append(cols["lo"][place] + np.repeat(begin, each))
                n.append(np.repeat(many, each))
        r, lo, n = merge_ranges(np.concatenate(r).astype(np.int64), np.concatenate(lo).astype(np.int64), np.concatenate(n).astype(np.int64))
        ends = np.column_stack((lo, lo + n)).astype("<u4")
        cut = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
        return pa.table({"ref": pa.array(r[cut]), "ranges": pa.array([ends[i:j].tobytes() for i, j in zip(cut.tolist(), np.append(cut[1:], len(r)).tolist())], pa.binary())})

    return run, "ref long, ranges binary"


def repeated_windows(docs: DataFrame, units: Units, solve: Callable, first_stays: bool, hot: int = HOT) -> DataFrame:
    """``docs`` (row, id, text, _ref) plus ``_ranges``: array of packed (start, end) window ranges that are repeated.

    ``first_stays``: only windows that also start earlier count, so a string's
    first place keeps what ``solve`` does not mark.
    """
    total = text_bytes(docs)
    count = buckets(total, BUCKET)
    common = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, units, "text", total, hot))
    run, schema = _mark(units, count, first_stays, common)
    marked = docs.select("_ref", "text").mapInArrow(run, schema)
    wanted = marked.groupBy("bucket").applyInArrow(lambda t: _wanted(t, first_stays), "ref long, h long, c long, lo int, n int, m int")
    asked = wanted.groupBy("ref").agg(F.collect_list(F.struct("h", "c", "ref", "lo", "n", "m")).alias("_want")).withColumnRenamed("ref", "_ref")
    ordered = docs.where("_ref is not null")  # never is; both joins then ask for one and the same exchange
    first = ordered.join(asked.hint("shuffle_merge"), "_ref").select(*docs.columns, "_want")
    run, schema = _fetch(units, count * SHARDS, docs.columns.index("text"))
    strings = first.mapInArrow(run, schema)
    run, schema = _solved(solve)
    verdicts = strings.groupBy("shard").applyInArrow(run, schema)
    run, schema = _applied(first_stays)
    ranges = marked.groupBy("bucket").cogroup(verdicts.groupBy("bucket")).applyInArrow(run, schema)
    found = ranges.groupBy("ref").agg(F.collect_list("ranges").alias("_ranges")).withColumnRenamed("ref", "_ref")
    return ordered.join(found.hint("shuffle_merge"), "_ref", "left").select(*docs.columns, "_ranges")


def covered(parts: list[bytes] | None, length: int, total: int) -> np.ndarray:
    """Mask of the units that a repeated window covers."""
    diff = np.zeros(total + 1, np.int32)
    for x in parts or ():
        e = np.frombuffer(x, "<u4").reshape(-1, 2).astype(np.int64)
        np.add.at(diff, e[:, 0], 1)
        np.add.at(diff, np.minimum(e[:, 1] - 1 + length, total), -1)
    return np.cumsum(diff[:-1]) > 0

