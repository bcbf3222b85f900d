"""Vectorised text primitives shared by the text operators.

A slice of texts is one ``uint8`` buffer plus row offsets (the Arrow layout, no
copy).  Words, their 64-bit hashes, n-gram hashes, winnowed anchors and interval
unions are computed for the whole slice with numpy, so no Python code runs per
word or per byte.  Slices are cut at :data:`SLICE` bytes, which bounds memory
whatever the Arrow batch size; one text longer than that is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW = {"p": np.ones(1, U), "i": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random value of each byte, for rolling hashes of windows of a few hundred bytes.
ROLL = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
#: What a byte counts as when spans are compared: itself, or with A-Z folded onto a-z.
BYTE = np.arange(256, dtype=np.uint8)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
#: Spans of more bytes are hashed one by one by xxh3; the first n bytes of a block of eight.
LONG = 256
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def lut(chars: bytes) -> np.ndarray:
    """True for the bytes in ``chars``."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~lut(b" \t\n\x0b\x0c\r")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_POW["p"]) < n:
        m = 1 << (n - 1).bit_length()
        for key, base in (("p", _BASE), ("i", _INV)):
            x = np.ones(m, U)
            x[1:] = U(base)
            _POW[key] = np.multiply.accumulate(x)
    return _POW["p"][:n], _POW["i"][:n]


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, end, buf[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def spans(buf: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``word`` bytes within rows, and the first word of each row (n + 1)."""
    m = word[buf]
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(m))]
    first[inner] = m[inner]
    last[inner - 1] = m[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def window_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit rolling hashes of spans of a few hundred units, from the prefix sums of value times power.

    Linear modulo 2**64, so texts of 1,024 bytes and more are known that collide: for bounded windows only.
    """
    h = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mix(h + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hashes of byte spans of any length, by their content and length.

    Each block of eight bytes goes through the non-linear finaliser together
    with the state before it.
    """
    if values is not BYTE:
        buf = values[buf]
    size = ends - starts
    h = mix(size.astype(U) * U(0xA0761D6478BD642F) + U(0x9E3779B97F4A7C15))
    blocks = np.ndarray((len(buf) + 1,), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[live], size[live]
    while len(live):
        h[live] = mix((h[live] ^ (blocks[at] & _FIRST[np.minimum(left, 8)])) * U(0x9FB21C651E98DF25))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(buf[starts[i] : ends[i]]))
    return h


def same_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, others: np.ndarray) -> bool:
    """Whether each span of ``buf`` has the bytes of the span of ``other`` that starts at the same place of ``others``; sizes are equal."""
    size = ends - starts
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return bool((buf[np.repeat(starts, size) + inside] == other[np.repeat(others, size) + inside]).all())


def words(buf: np.ndarray, off: np.ndarray, word: np.ndarray = NOT_SPACE, values: np.ndarray = BYTE):
    """starts, ends, first word of each row, hash of each word."""
    s, e, row = spans(buf, off, word)
    return s, e, row, span_hash(buf, s, e, values)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, by start; the last n - 1 starts are left out."""
    if len(h) < n:
        return np.zeros(0, U)
    out = h[: len(h) - n + 1] * U(1)
    for i in range(1, n):
        out *= U(0x2545F4914F6CDD1D)
        out ^= out >> U(32)
        out += h[i : len(h) - n + 1 + i]
    return mix(out)


def row_starts(row: np.ndarray, n: int) -> np.ndarray:
    """Mask over n-gram starts: True where the n words lie in one row."""
    total = int(row[-1])
    if total < n:
        return np.zeros(0, bool)
    diff = np.zeros(total + 1, np.int64)
    size = np.diff(row)
    ok = size >= n
    np.add.at(diff, row[:-1][ok], 1)
    np.add.at(diff, row[1:][ok] - n + 1, -1)
    return np.cumsum(diff)[: total - n + 1] > 0


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Leftmost position of the minimum of each ``w`` consecutive values, by window start."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    size, val, arg = 1, x, np.arange(len(x))
    while size * 2 <= w:
        a, b = val[:-size], val[size:]
        right = b < a
        arg = np.where(right, arg[size:], arg[:-size])
        val = np.where(right, b, a)
        size *= 2
    if size < w:
        d = w - size
        right = val[d : d + n] < val[:n]
        return np.where(right, arg[d : d + n], arg[:n])
    return arg[:n]


def union_length(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Mask of the ``total`` places covered by [start, start + length)."""
    diff = np.zeros(total + 1, np.int32)
    np.add.at(diff, starts, 1)
    np.add.at(diff, np.minimum(starts + length, total), -1)
    return np.cumsum(diff[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def counts_within(row_of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Mask of the items whose (row, hash) is there twice or more."""
    key = mix(row_of.astype(U) * U(0xE7037ED1A0B428DB) + U(1)) ^ h
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out
