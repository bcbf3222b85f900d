"""Operator 7, n-gram Jaccard join: rare-first prefix filtering.

1. One pass gives each document its set size and a 128-bit signature of its set;
   equal sets are one class, represented by their smallest reference.  The pass
   also counts shingles into a sketch of fixed size (2**20 counters, 1 MB when
   sent to tasks), which only tells the very common ones (``hot``) apart.
2. All other shingles go to buckets by their hash, packed, and are counted there
   exactly: the order is by document frequency at any size of input.  A shingle
   of one document joins nothing, so it only takes its place in the order; the
   rest go back to their documents, where each class cuts its prefix: shingles of
   one document first, then by frequency, hot ones last.
3. Prefixes are joined by shingle.  Each shingle's hub is the class that has the
   fewest rarer shingles before it, the middle of a family of near copies rather
   than one of its members; all its other classes are paired with the hub alone.
4. Where classes of a shingle are still in different components, those outside
   the largest one are held against all others of the shingle, in parts of
   bounded size; pairs of one component need no further look.  No pair that the
   filters let through is left out, so no link that matters is lost.
5. In both rounds length, prefix and positional filters come first, then parity
   bitmaps (1024 bits over the whole set: they never differ in more bits than the
   sets in shingles), then, on the sets themselves, the suffix filter and the
   count.  Each pair is verified once.
6. Components by alternating stars.

Hot shingles, and hubs and classes of very many rows, are salted or joined by a
broadcast of bounded size.  Tokens are hashes of 48 bits in the join: equal ones
of different shingles only add pairs that are verified.

Two sets link when ``100 * intersection >= percent * union``.  Null and empty
texts have an empty set, link with nothing and are their own component; texts of
fewer than ``n`` words are one shingle; a text of any length is taken whole, in
one task.  Null ids sort last; rows that are fully repeated share a reference and
a component.  An empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._components import components
from ._io import buckets, materialize, quoted, scratch, skew_join, text_bytes, with_ref
from ._vec import BYTE_LOWER, NOT_SPACE, U, mix, ngrams, row_starts, text_slices, words

SLOTS = 1 << 20
_BLOCK = 1 << 14
BITS = 1024
#: Bytes of text whose shingles a bucket counts; shingles that a task packs at once.
BUCKET, FLUSH = 4 << 20, 1_000_000
#: A counter from which its shingles are hot (or eight times the usual one); salts of their rows.
HOT, HOT_SALTS = 4096, 64
#: Most classes of a shingle that are held against others at once, and most others in a part.
LEFT, RIGHT = 1024, 2048
#: Pairs of a hub that are verified together, and most such parts of a hub.
SALT, SALTS = 256, 4096
_T = U(48)
_FEW = (1 << 13) - 1


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int):
    """Row and hash of each distinct shingle, sorted by row then hash, and each row's first (n + 1)."""
    _, _, row, h = words(buf, off, NOT_SPACE, BYTE_LOWER)
    size = np.diff(row)
    g = ngrams(h, n)
    at = np.flatnonzero(row_starts(row, n)) if len(g) else np.zeros(0, np.int64)
    rows, hashes = [np.searchsorted(row, at, "right") - 1], [g[at]]
    for k in range(1, n):  # texts of k words only: the whole sequence
        few = np.flatnonzero(size == k)
        if len(few):
            rows.append(few)
            hashes.append(ngrams(h, k)[row[few]] ^ U(k))
    r, x = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((x, r))
    r, x = r[order], x[order]
    if len(r):
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1])))
        r, x = r[new], x[new]
    return r, x, np.searchsorted(r, np.arange(len(off)))


def _sums(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate((np.zeros(1, U), np.cumsum(v, dtype=U)))
    return c[first[1:]] - c[first[:-1]]


def _sign(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first).astype(U)
    return mix(_sums(mix(x), first) + n), mix(_sums(mix(x ^ U(0x5851F42D4C957F2D)), first) + n)


def _bitmaps(r: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """Parity of the shingles that fall on each bit, by row: (rows, BITS / 8) bytes."""
    out = np.zeros((rows, BITS // 8), np.uint8)
    bit = (x & U(BITS - 1)).astype(np.int64)
    for i in range(0, rows, 1024):
        a, b = np.searchsorted(r, [i, min(i + 1024, rows)])
        k = min(1024, rows - i)
        odd = np.bincount((r[a:b] - i) * BITS + bit[a:b], minlength=k * BITS) & 1
        out[i : i + k] = np.packbits(odd.astype(np.uint8).reshape(k, BITS), axis=1)
    return out


def _most(nx, ny, percent: int):
    """How many shingles two linked sets of these sizes can differ in."""
    return nx + ny - 2 * (-(-percent * (nx + ny) // (100 + percent)))


def _describe(n: int):
    def run(batches):
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(1)):
                r, x, first = shingle_sets(buf, off, n)
                bits = _bitmaps(r, x, b - a)
                counts += np.bincount((x >> U(44)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
                s1, s2 = _sign(x, first)
                m = b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), pa.array(np.diff(first), pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([y.tobytes() for y in bits], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["ref", "n", "s1", "s2", "bits", "block", "counts"])
        if counts.any():
            blocks = SLOTS // _BLOCK
            none = pa.nulls(blocks, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(blocks, pa.binary()), pa.array(range(blocks), pa.int32()), pa.array([counts[i * _BLOCK : (i + 1) * _BLOCK].tobytes() for i in range(blocks)], pa.binary())], ["ref", "n", "s1", "s2", "bits", "block", "counts"])

    return run, "ref long, n long, s1 long, s2 long, bits binary, block int, counts binary"


def _add_blocks(t: pa.Table) -> pa.Table:
    total = np.zeros(_BLOCK, np.uint64)
    for x in t["counts"]:
        total += np.frombuffer(x.as_buffer(), np.uint32)
    return pa.table({"block": t["block"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def hot_levels(described: DataFrame) -> np.ndarray:
    """0 for counters that are not hot, else about the binary logarithm of the counter (1 MB)."""
    total = np.zeros(SLOTS, np.uint64)
    for x in described.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(_add_blocks, "block int, counts binary").collect():
        total[x.block * _BLOCK : (x.block + 1) * _BLOCK] = np.frombuffer(x.counts, np.uint64)
    usual = float(np.median(total[total > 0])) if total.any() else 0.0
    return np.where(total >= max(HOT, 8 * usual), 1 + np.log2(np.maximum(total, 1)), 0).astype(np.uint8)


def _planes(x: np.ndarray) -> bytes:
    """64-bit values by byte place, for compression."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(x: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _spread(x: np.ndarray, count: int) -> np.ndarray:
    """Bucket by the top bits of 48."""
    return ((x >> U(16)) * U(count)) >> U(32)


def _home(ref: np.ndarray, count: int) -> np.ndarray:
    return _spread(mix(ref.view(U) + U(3)) >> U(16), count).astype(np.int64)


def _prefix_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _cut(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Values of sorted keys, and where each one's run begins and ends."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], list(zip(first.tolist(), np.append(first[1:], len(keys)).tolist()))


_PACKED = "bucket int, a binary, b binary"


def _packed(ids: np.ndarray, cut: list, a: np.ndarray, b: np.ndarray, delta: bool):
    d = lambda x: np.diff(x, prepend=U(0)) if delta else x
    for i in range(0, len(ids), 256):
        part = cut[i : i + 256]
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 256].astype(np.int64), pa.int32()), pa.array([_planes(d(a[x:y])) for x, y in part], pa.binary()), pa.array([_planes(b[x:y]) for x, y in part], pa.binary())], ["bucket", "a", "b"])


def _deal(n: int, percent: int, levels, count: int):
    """Shingles that are not hot, by bucket; at ``count`` + home of the document: its number of hot ones and those its prefix needs."""

    def run(batches):
        level, held, size = levels.value, [], 0

        def flush():
            t, ref = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            order = np.argsort(t)
            t, ref = t[order], ref[order]
            yield from _packed(*_cut(_spread(t, count)), t, ref.view(U), True)

        for batch in batches:
            refs = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, buf, off in text_slices(batch.column(1)):
                r, x, first = shingle_sets(buf, off, n)
                if not len(r):
                    continue
                lvl, t, ref = level[(x >> U(44)).astype(np.int64)], mix(x) >> U(16), refs[a:b][r]
                cool = lvl == 0
                held.append((t[cool], ref[cool]))
                size += int(cool.sum())
                if not cool.all():
                    warm = ~cool
                    hr, w = r[warm], (U(1) << U(62)) | (lvl[warm].astype(U) << _T) | t[warm]
                    order = np.lexsort((w, hr))
                    hr, w = hr[order], w[order]
                    many = np.bincount(hr, minlength=b - a)
                    at = np.arange(len(hr)) - (np.cumsum(many) - many)[hr]
                    sizes = np.diff(first)
                    need = at < (_prefix_size(sizes, percent) - sizes + many)[hr]
                    some = np.flatnonzero(many)
                    owner = np.concatenate((hr[need], some))
                    w = np.concatenate((w[need], (U(2) << U(62)) | many[some].astype(U)))
                    ref = refs[a:b][owner]
                    home = _home(ref, count)
                    order = np.argsort(home)
                    ids, cut = _cut(home[order])
                    yield from _packed(ids + count, cut, ref[order].view(U), w[order], False)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run, _PACKED


def _count(count: int):
    """Shingles that stand in two documents or more, with their frequency, back to the homes of their documents."""

    def run(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() >= count:
            return t.set_column(0, "bucket", pa.array(t["bucket"].to_numpy() - count, pa.int32()))
        tok = np.concatenate([np.cumsum(_unplanes(x), dtype=U) for x in t["a"]])
        ref = np.concatenate([_unplanes(x) for x in t["b"]])
        order = np.argsort(tok)
        tok = tok[order]
        first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        size = np.diff(np.append(first, len(tok)))
        freq = np.repeat(size, size)
        keep = freq > 1
        w = (np.minimum(freq[keep], _FEW).astype(U) << _T) | tok[keep]
        ref = ref[order[keep]]
        home = _home(ref.view(np.int64), count)
        order = np.argsort(home)
        parts = list(_packed(*_cut(home[order]), ref[order], w[order], False))
        return pa.Table.from_batches(parts) if parts else t.slice(0, 0)

    return run, _PACKED


_TOKENS = "t long, k long, n int, p int, hot boolean"


def _prefixes(percent: int):
    """Prefix of each class: rows of its shingles that stand elsewhere too, with their places in its order."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("t", pa.int64()), ("k", pa.int64()), ("n", pa.int32()), ("p", pa.int32()), ("hot", pa.bool_())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ref = np.concatenate([_unplanes(x) for x in left["a"]]).view(np.int64)
        w = np.concatenate([_unplanes(x) for x in left["b"]])
        reps, sizes = right["ref"].to_numpy(), right["n"].to_numpy()
        order = np.argsort(reps)
        reps, sizes = reps[order], sizes[order]
        at = np.minimum(np.searchsorted(reps, ref), len(reps) - 1)
        mine = reps[at] == ref
        at, w = at[mine], w[mine]
        order = np.lexsort((w, at))
        at, w = at[order], w[order]
        kind = (w >> U(62)).astype(np.int64)
        warm = np.zeros(len(reps), np.int64)
        warm[at[kind == 2]] = (w[kind == 2] & U((1 << 62) - 1)).astype(np.int64)
        at, w, kind = at[kind < 2], w[kind < 2], kind[kind < 2]
        cool = np.bincount(at[kind == 0], minlength=len(reps))
        begin = np.searchsorted(at, np.arange(len(reps)))
        # single ones stand before these, so their places follow from the sizes
        p = np.arange(len(at)) - begin[at] + (sizes - warm - cool)[at]
        keep = p < _prefix_size(sizes[at], percent)
        t = w & U((1 << 48) - 1) | (kind.astype(U) << _T)
        return pa.table([pa.array(t[keep].view(np.int64)), pa.array(reps[at[keep]]), pa.array(sizes[at[keep]], pa.int32()), pa.array(p[keep], pa.int32()), pa.array(kind[keep] == 1)], schema=schema)

    return run, _TOKENS


def _passes(nx, ny, px, py, percent: int):
    """Length, index-prefix and positional filters for a shared shingle at px and py; arrays or numbers."""
    big_x = nx >= ny
    big, small = np.where(big_x, nx, ny), np.where(big_x, ny, nx)
    at_small = np.where(big_x, py, px)
    need = -(-percent * (nx + ny) // (100 + percent))
    index = small - -(-2 * percent * small // (100 + percent)) + 1
    # of equal sizes either may be the smaller
    at_small = np.where(nx == ny, np.minimum(px, py), at_small)
    return (100 * small >= percent * big) & (at_small < index) & (1 + np.minimum(nx - px - 1, ny - py - 1) + np.minimum(px, py) >= need)


def _passes_column(percent: int):
    """``_passes`` of columns n, p and hn, hp."""
    small, big = F.least("n", "hn"), F.greatest("n", "hn")
    at_small = F.when(F.col("n") == F.col("hn"), F.least("p", "hp")).when(F.col("n") > F.col("hn"), F.col("hp")).otherwise(F.col("p"))
    need = F.ceil(percent * (F.col("n") + F.col("hn")) / F.lit(100 + percent))
    index = small - F.ceil(2 * percent * small / F.lit(100 + percent)) + 1
    return (100 * small >= percent * big) & (at_small < index) & (1 + F.least(F.col("n") - F.col("p") - 1, F.col("hn") - F.col("hp") - 1) + F.least("p", "hp") >= need)


def hub_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """(x, hub): each class of a shingle with the shingle's hub, where the filters let them through."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("k"), F.lit(HOT_SALTS))).otherwise(0).cast("int")
    hubs = tokens.groupBy("t").agg(F.min(F.struct("p", "k", "n")).alias("h"), F.first("hot").alias("hot"), F.count("*").alias("c")).where("c > 1")
    salts = F.sequence(F.lit(0), F.when(F.col("hot"), HOT_SALTS - 1).otherwise(0))
    hubs = hubs.select("t", F.explode(salts).alias("salt"), F.col("h.k").alias("hub"), F.col("h.n").alias("hn"), F.col("h.p").alias("hp"))
    met = tokens.withColumn("salt", salt).join(hubs, ["t", "salt"]).where((F.col("k") != F.col("hub")) & _passes_column(percent))
    return met.select(F.least("k", "hub").alias("x"), F.greatest("k", "hub").alias("y"), "hub").groupBy("x", "y").agg(F.min("hub").alias("hub"))


def open_rows(tokens: DataFrame, comp: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows of shingles whose classes are in several components, by parts: ``side`` 0 is held against ``side`` 1."""
    mine = tokens.join(comp, tokens.k == comp.node, "left").select("t", "k", "n", "p", "hot", F.coalesce("component", "k").alias("comp"))
    mine = materialize(mine, "open")
    per = mine.groupBy("t", "comp").agg(F.count("*").alias("c"), F.first("hot").alias("hot"))
    per = per.groupBy("t").agg(F.max_by("comp", "c").alias("main"), F.max("c").alias("most"), F.sum("c").alias("c"), F.count("*").alias("several"), F.first("hot").alias("hot")).where("several > 1")
    per = per.select("t", "main", F.ceil((F.col("c") - F.col("most")) / LEFT).cast("int").alias("lefts"), F.ceil(F.col("c") / RIGHT).cast("int").alias("rights"), F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), HOT_SALTS - 1).otherwise(0))).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("k"), F.lit(HOT_SALTS))).otherwise(0).cast("int")
    met = mine.withColumn("salt", salt).join(per, ["t", "salt"]).join(bits, "k")
    own = lambda parts: F.array(F.pmod(F.xxhash64("k", F.lit(5)), F.col(parts)).cast("int"))
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    side = lambda which, df, left, right: df.withColumn("i", F.explode(left)).withColumn("j", F.explode(right)).select("t", "i", "j", F.lit(which).alias("side"), "k", "n", "p", "comp", (F.col("comp") == F.col("main")).alias("main"), "bits")
    return side(0, met.where("comp <> main"), own("lefts"), every("rights")).union(side(1, met, every("lefts"), own("rights")))


def _open_pairs(percent: int):
    """Pairs of different components whose bitmaps may belong to linked sets; rows come sorted by part and side."""

    def run(batches):
        key, held, fixed = None, [], None
        seen: set = set()
        for batch in batches:
            t, i, j, side, k, n, p, comp = (batch.column(c).to_numpy() for c in range(8))
            main = batch.column(8).to_numpy(zero_copy_only=False)
            bits = np.frombuffer(b"".join(batch.column(9).to_pylist()), U).reshape(len(t), BITS // 64)
            edge = np.flatnonzero((t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (side[1:] != side[:-1])) + 1
            found = []
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(t)]):
                here = (int(t[lo]), int(i[lo]), int(j[lo]))
                if here != key:
                    key, held, fixed = here, [], None
                cols = tuple(x[lo:hi] for x in (k, n, p, comp, main, bits))
                if side[lo] == 0:
                    held.append(cols)
                    continue
                if not held:
                    continue
                if fixed is None:
                    fixed = [np.concatenate(x) for x in zip(*held)]
                    order = np.argsort(fixed[1], kind="stable")
                    fixed = [x[order] for x in fixed]
                lk, ln, lp, lc, _, lb = fixed
                rk, rn, rp, rc, rm, rb = cols
                # sizes within the length filter only
                low = np.searchsorted(ln, -(-percent * rn // 100))
                high = np.searchsorted(ln, 100 * rn // percent, "right")
                for a in range(len(rk)):
                    s = slice(int(low[a]), int(high[a]))
                    ok = np.flatnonzero((lc[s] != rc[a]) & (rm[a] | (lk[s] < rk[a])) & _passes(ln[s], rn[a], lp[s], rp[a], percent)) + s.start
                    ok = ok[np.bitwise_count(lb[ok] ^ rb[a]).sum(axis=1) <= _most(ln[ok], rn[a], percent)] if len(ok) else ok
                    for x in lk[ok].tolist():
                        pair = (min(x, int(rk[a])), max(x, int(rk[a])))
                        if pair not in seen:
                            seen.add(pair)
                            found.append(pair)
            if len(seen) > 1 << 20:
                seen = set()
            if found:
                got = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["x", "y"])

    return run, "x long, y long"


def suffix_passes(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> bool:
    """False only if the sorted sets surely differ in more than ``most`` places: split both at a middle value, add the parts' size gaps."""

    def gap(a, b, c, d, level):
        if level == 0 or b - a == 0 or d - c == 0:
            return abs((b - a) - (d - c))
        m = (c + d) // 2
        w = y[m]
        q = a + int(np.searchsorted(x[a:b], w))
        same = q < b and x[q] == w
        return gap(a, q, c, m, level - 1) + gap(q + same, b, m + 1, d, level - 1) + (not same)

    return gap(0, len(x), 0, len(y), depth) <= most


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    total = len(x) + len(y)
    need = -(-percent * total // (100 + percent))
    if not suffix_passes(x, y, total - 2 * need):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= need


def _verify(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) among ``pairs`` (x, hub).  A hub of many pairs is salted; its set goes to each salt, and others stream past it."""
    deg = materialize(pairs.groupBy("hub").agg(F.least(F.ceil(F.count("*") / SALT), F.lit(SALTS)).cast("int").alias("parts")), "degrees")
    salted = skew_join(pairs, deg, ["hub"]).select("x", "hub", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("salt"))
    want = salted.select(F.col("x").alias("_ref"), "hub", "salt", F.lit(1).alias("side"))
    want = want.union(deg.select(F.col("hub").alias("_ref"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("side")))
    want = materialize(want.groupBy("_ref").agg(F.collect_list(F.struct("hub", "salt", "side")).alias("want")), "want")
    texts = docs.select("_ref", "text").mapInArrow(_only(_filter_bits(want)), "_ref long, text string")
    found = texts.join(want.hint("shuffle_merge"), "_ref")

    def sets(batches):
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(1)):
                _, x, first = shingle_sets(buf, off, n)
                part = batch.column(2).slice(a, b - a)
                times, v = part.value_lengths().to_numpy(zero_copy_only=False), part.flatten()
                ref = np.repeat(batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False), times)
                raw = [x[i:j].tobytes() for i, j in zip(first.tolist(), first[1:].tolist())]
                rows = np.repeat(np.arange(b - a), times).tolist()
                for i in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([v.field("hub").slice(i, 512), v.field("salt").slice(i, 512), v.field("side").slice(i, 512), pa.array(ref[i : i + 512]), pa.array([raw[j] for j in rows[i : i + 512]], pa.binary())], ["hub", "salt", "side", "ref", "set"])

    def check(batches):
        at, hub = None, None
        for batch in batches:
            out = []
            for h, s, side, ref, data in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4)):
                if side == 0:
                    at, hub = (h, s), np.frombuffer(data.as_py(), U)
                elif at == (h, s) and links(np.frombuffer(data.as_buffer(), U), hub, percent):
                    out.append((ref, h))
            got = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["u", "v"])

    dealt = found.mapInArrow(sets, "hub long, salt int, side int, ref long, set binary").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side")
    return dealt.mapInArrow(check, "u long, v long")


_BITS = 1 << 24


def _slot(ref: np.ndarray) -> np.ndarray:
    return (mix(ref.astype(np.int64).view(U) + U(1)) >> U(40)).astype(np.int64)


def _filter_bits(want: DataFrame):
    """A one-hash Bloom filter of 2 MB, whatever the number of rows: spares the exchange most texts that nobody asks for."""
    blocks = 64
    width = _BITS // blocks

    def run(batches):
        bits = np.zeros(_BITS, np.uint8)
        for batch in batches:
            bits[_slot(batch.column(0).to_numpy(zero_copy_only=False))] = 1
        if bits.any():
            for i in range(blocks):
                part = bits[i * width : (i + 1) * width]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["block", "bits"])

    def merge(t: pa.Table) -> pa.Table:
        got = np.zeros(width // 8, np.uint8)
        for x in t["bits"]:
            got |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"block": t["block"].slice(0, 1), "bits": pa.array([got.tobytes()], pa.binary())})

    out = np.zeros(_BITS // 8, np.uint8)
    for x in want.select("_ref").mapInArrow(run, "block int, bits binary").groupBy("block").applyInArrow(merge, "block int, bits binary").collect():
        out[x.block * width // 8 : (x.block + 1) * width // 8] = np.frombuffer(x.bits, np.uint8)
    return want.sparkSession.sparkContext.broadcast(out)


def _only(bits):
    def run(batches):
        for batch in batches:
            s = _slot(batch.column(0).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array((bits.value[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1))

    return run


def _repeated(described: DataFrame) -> bool:
    """Whether rows share a reference: such rows are equal."""
    n, k = described.where("ref is not null").agg(F.count("*"), F.count_distinct("ref")).first()
    return n != k


def _home_column(count: int):
    """``_home`` of the column k."""

    @F.pandas_udf("int")
    def home(k: pd.Series) -> pd.Series:
        return pd.Series(_home(k.to_numpy().astype(np.int64), count).astype(np.int32))

    return home("k")


def _plausible(percent: int):
    """Pairs (x, hub) whose bitmaps may belong to linked sets, from (x, hub, bx, bh, nx, nh)."""

    def keep(batches):
        for b in batches:
            if b.num_rows:
                x, h = (np.frombuffer(b"".join(b.column(i).to_pylist()), U).reshape(b.num_rows, -1) for i in (2, 3))
                ok = np.bitwise_count(x ^ h).sum(axis=1) <= _most(b.column(4).to_numpy(), b.column(5).to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["x", "hub"])

    return keep, "x long, hub long"


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id: the smallest id reachable by links.  Only the result's table is left in the scratch folder."""
    with scratch(docs.sparkSession) as outer:
        return materialize(_joined(docs, id_col, text_col, n, percent), "jaccard", outer)


def _joined(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    keyed = with_ref(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), "id", "text")
    run, schema = _describe(n)
    described = materialize(keyed.select("_ref", "text").mapInArrow(run, schema), "sets")
    levels = spark.sparkContext.broadcast(hot_levels(described))
    sets = described.where("ref is not null").select("ref", "n", "s1", "s2")
    classes = described.where("n > 0").groupBy("s1", "s2").agg(F.min("ref").alias("rep"), F.first("n").cast("int").alias("n"))
    classes = materialize(classes, "classes")
    bits = described.where("n > 0").select(F.col("ref").alias("k"), "bits", F.col("n").cast("int").alias("size"))
    bits = materialize(bits.join(classes.select(F.col("rep").alias("k")), "k", "left_semi").dropDuplicates(["k"]), "bits")
    count = buckets(text_bytes(keyed), BUCKET)
    run, schema = _deal(n, percent, levels, count)
    dealt = keyed.select("_ref", "text").dropDuplicates(["_ref"]) if _repeated(described) else keyed.select("_ref", "text")
    dealt = dealt.mapInArrow(run, schema)
    run, schema = _count(count)
    back = dealt.groupBy("bucket").applyInArrow(run, schema)
    run, schema = _prefixes(percent)
    home = bits.select(_home_column(count).alias("bucket"), F.col("k").alias("ref"), F.col("size").alias("n"))
    tokens = materialize(back.groupBy("bucket").cogroup(home.groupBy("bucket")).applyInArrow(run, schema), "tokens")

    hubs = materialize(hub_pairs(tokens, percent), "hubs")
    both = hubs.select(F.when(F.col("x") == F.col("hub"), F.col("y")).otherwise(F.col("x")).alias("x"), "hub")
    both = both.join(bits.withColumnsRenamed({"k": "x", "bits": "bx", "size": "nx"}), "x")
    both = skew_join(materialize(both, "halves"), bits.withColumnsRenamed({"k": "hub", "bits": "bh", "size": "nh"}), ["hub"])
    run, schema = _plausible(percent)
    tried = materialize(both.select("x", "hub", "bx", "bh", "nx", "nh").mapInArrow(run, schema), "tried")
    edges = materialize(_verify(keyed, tried, n, percent), "links")
    comp = components(edges)
    run, schema = _open_pairs(percent)
    rows = open_rows(tokens, comp, bits.select("k", "bits")).repartition("t", "i", "j").sortWithinPartitions("t", "i", "j", "side")
    more = rows.mapInArrow(run, schema).distinct()
    more = materialize(more.join(tried.select(F.least("x", "hub").alias("x"), F.greatest("x", "hub").alias("y")), ["x", "y"], "left_anti").withColumnRenamed("y", "hub"), "tried")
    if not more.isEmpty():
        edges = edges.union(materialize(_verify(keyed, more, n, percent), "links"))
        comp = components(edges)
    ids = keyed.select(F.col("_ref").alias("ref"), "id").distinct()
    named = skew_join(sets, classes.drop("n"), ["s1", "s2"], "left").join(comp, F.col("rep") == F.col("node"), "left")
    named = named.select("ref", "n", F.coalesce("component", F.when(F.col("n") > 0, F.col("rep")), "ref").alias("c")).dropDuplicates(["ref"])
    smallest = ids.select(F.col("ref").alias("c"), F.col("id").alias("component_id"))
    out = skew_join(materialize(keyed.select("id", F.col("_ref").alias("ref")).join(named, "ref"), "classed"), smallest, ["c"])
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def query(spark, sf_dir):
    from ._io import table

    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 85 * (a.n + b.n - i)),
both_ways AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT b.v, r.c FROM r JOIN both_ways b ON b.u = r.u)
SELECT doc_id, n AS n_shingles, min(c) AS component_id FROM n JOIN r ON r.u = n.doc_id GROUP BY ALL
"""
