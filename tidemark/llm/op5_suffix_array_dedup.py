"""Operator 5, suffix-array dedup: the common-prefix interval tree.

Strings that may hold a repeat meet in a shard (see ``_repeats``).  There an
enhanced suffix array is scanned with a stack.  Only common prefixes of
``least`` or more matter, so suffixes that share their first ``least`` symbols
are brought together first and only those are ordered, seven symbols at a time
while they are tied.  Every interval of the tree whose occurrences differ in the
character on their left is a maximal repeat group with all its occurrences.  A
repeat that extends to the left is part of a longer one and is skipped, with
everything below it in the tree.  A string that stands in several places is one
string with a weight, and a group of itself.

Every byte that a repeat covers is removed, in all its places, so ties are none:
no place is the one that stays.  Nulls are empty; texts shorter than ``least``
lose nothing; a text of any length is cut into strings of at most
``2 * least - k`` bytes.  Repeated rows, with or without an id, are places of
their own, so both lose what they share.  Extra columns are kept whatever their
names, but for ``n_removed`` and ``n_spans``, which the operator's own replace.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._io import packed_rows, unpacked_rows, with_ref
from ._repeats import HOT, Units, covered, repeated_windows
from ._vec import U, mix, powers, runs, text_slices

_STEP = 7


def joined(content: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings as symbols from 1, each ended by 0; their starts; the end of the string at each place."""
    sizes = np.array([len(x) + 1 for x in content])
    stops = np.cumsum(sizes)
    text = np.frombuffer(b"\0".join(content) + b"\0", np.uint8).astype(np.uint16) + 1
    text[stops - 1] = 0
    return text, stops - sizes, np.repeat(stops - 1, sizes)


#: A value for each symbol, for the hashes of places.
_SYMBOL = mix(np.arange(1, 258, dtype=U) * U(0xDA942042E4DD58B5))


def _alike(text: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places whose first ``least`` symbols stand at another place too, grouped by them (64-bit hashes); heads of the groups."""
    if not len(places):
        return places, np.zeros(0, bool)
    up, down = powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, U)
    np.cumsum(_SYMBOL[text] * up[:-1], out=sums[1:])
    h = (sums[places + least] - sums[places]) * down[places]
    del sums
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    head = np.concatenate(([True], ~same))
    twice = np.concatenate((same, [False])) | ~head
    return places[order[twice]], head[twice]


def suffix_array(text: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share ``least`` symbols with another, and the common prefix of each with the one before it.

    Those that share their first ``least`` symbols stand together, ordered by
    what follows; 0, which ends a string, stands before all other symbols and is
    not part of a common prefix.  The common prefix is 0 where a group begins.
    """
    at, head = _alike(text, places, least)
    common = np.zeros(len(at), np.int64)
    wide = np.concatenate((text, np.zeros(_STEP, text.dtype)))
    tied = np.arange(len(at))  # slots of suffixes that are not told apart yet
    group = np.cumsum(head)
    depth = least
    while len(tied):
        p = at[tied] + depth
        key, open_, size = np.zeros(len(p), U), np.ones(len(p), bool), np.zeros(len(p), np.int64)
        for i in range(_STEP):
            c = wide[np.minimum(p + i, len(wide) - 1)]
            open_ &= c > 0
            size += open_
            key |= (c * open_).astype(U) << U(54 - 9 * i)
        rank = np.argsort(key)
        dense = np.empty(len(p), np.int64)
        s = key[rank]
        dense[rank] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
        order = np.argsort((group[tied] << 32) | dense)
        at[tied], key, size = at[tied][order], key[order], size[order]
        inside = np.concatenate(([False], group[tied][1:] == group[tied][:-1]))
        same = inside & np.concatenate(([False], key[1:] == key[:-1]))
        apart = inside & ~same
        x = key[apart] ^ key[np.flatnonzero(apart) - 1]
        common[tied[apart]] = depth + sum((x >> U(54 - 9 * i)) == 0 for i in range(_STEP))
        ended = same & (size < _STEP)
        common[tied[ended]] = depth + size[ended]
        more = same & ~ended
        group[tied] = np.cumsum(~same) + len(at)  # within the old groups, in order
        go = more | np.concatenate((more[1:], [False]))
        tied = tied[go]
        depth += _STEP
    return at, common


def maximal_repeats(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """(length, all places) of each maximal repeat of ``least`` bytes or more among ``joined`` strings."""
    order, lcp = suffix_array(text, np.flatnonzero(ends - np.arange(len(text)) >= least), least)
    if not len(order):
        return []
    left = np.empty(len(text), np.int32)
    left[1:] = text[:-1]
    left[starts] = -1 - np.arange(len(starts))  # nothing is known there: differs from all
    left = left[order]
    first = np.flatnonzero(lcp < least)
    low, high = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
    out = []
    for i, j in np.column_stack((first, np.append(first[1:], len(order))))[low != high].tolist():
        stack: list[list] = []  # [common prefix, first suffix, a left character, they differ]
        depths, lefts = lcp[i + 1 : j].tolist(), left[i:j].tolist()
        for k in range(j - i):
            here = depths[k] if k < len(depths) else 0
            c, differ, begin = lefts[k], False, k
            while stack and stack[-1][0] > here:
                depth, b, c0, d0 = stack.pop()
                d0 = d0 or differ or c0 != c
                if d0:
                    out.append((depth, order[i + b : i + k + 1]))
                c, differ, begin = c0, d0, b
            if here >= least:
                if stack and stack[-1][0] == here:
                    stack[-1][3] = stack[-1][3] or differ or stack[-1][2] != c
                else:
                    stack.append([here, begin, c, differ])
    return out


def solver(least: int):
    def solve(cols: dict, content: list[bytes]) -> list:
        text, starts, ends = joined(content)
        found = maximal_repeats(text, starts, ends, least)
        several = cols["m"] > 1  # a string of weight two is a group of its own
        begin = [starts[several], *(at for _, at in found)]
        many = [(ends[starts] - starts - least + 1)[several], np.repeat(np.array([d - least + 1 for d, _ in found], np.int64), [len(at) for _, at in found])]
        begin, many = np.concatenate(begin), np.concatenate(many)
        diff = np.bincount(begin, minlength=len(text) + 1) - np.bincount(begin + many, minlength=len(text) + 1)
        hit = np.cumsum(diff[:-1]) > 0
        return [hit[s : s + n] for s, n in zip(starts.tolist(), cols["n"].tolist())]

    return solve


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, k: int = 32, digest: bool = False, hot: int = HOT) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text, by whole characters, plus n_removed and n_spans.

    With ``digest`` the result is instead: id, n_bytes, n_removed, n_spans, kept_sha256, on exact bytes.
    """
    keyed = with_ref(packed_rows(docs, id_col, text_col), "id", "text")
    if digest:
        keyed = keyed.drop("row")
    ranged = repeated_windows(keyed, Units("byte", least, k), solver(least), first_stays=False, hot=hot)
    picked = ranged.select("id" if digest else "row", "text", "_ranges")
    kind = picked.schema[0].dataType.simpleString()
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["row", "text", "n_removed", "n_spans"]
    made = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = made if digest else picked.select("row", "text", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans")).schema

    def run(batches):
        for batch in batches:
            parts = batch.column(2)
            for a, b, buf, off in text_slices(batch.column(1)):
                n = b - a
                removed, spans, kept = [0] * n, [0] * n, [None] * n
                o = off.tolist()
                for i, x in enumerate(parts.slice(a, n)):
                    raw = buf[o[i] : o[i + 1]]
                    if x.is_valid and len(x):
                        gone = covered(x.as_py(), least, len(raw))
                        if not digest:  # whole characters only: one with a byte that stays, stays
                            lead = np.flatnonzero((raw & 0xC0) != 0x80)
                            gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(raw)))) if len(lead) else gone
                        removed[i], spans[i] = int(gone.sum()), len(runs(gone)[0])
                        raw = raw[~gone]
                    kept[i] = hashlib.sha256(raw.tobytes()).hexdigest() if digest else raw.tobytes().decode("utf-8", "replace")
                counts = [pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
                mine = batch.column(0).slice(a, n)
                if digest:
                    yield pa.RecordBatch.from_arrays([mine, pa.array(np.diff(off), pa.int64()), *counts, pa.array(kept, pa.string())], names)
                else:
                    null = batch.column(1).slice(a, n).is_null().to_pylist()
                    yield pa.RecordBatch.from_arrays([mine, pa.array([None if z else t for z, t in zip(null, kept)], pa.string()), *counts], names)

    out = picked.mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col) if digest else unpacked_rows(out, docs.columns, text_col, ["n_removed", "n_spans"])


def query(spark, sf_dir):
    from ._io import table

    return dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)
