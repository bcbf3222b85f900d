"""Exact encoding of large corpora through a memo of distinct chunks.

A tokenizer that never merges across a white-space boundary encodes a text to
the concatenation of its chunks' encodings.  Chunks are found and hashed with
numpy; each distinct chunk is encoded once per worker by the tokenizer itself;
the ids of whole texts are then gathered from one flat array.  A worker outlives
the stage that tokenizes, so a memo that no task uses for a while is dropped.
"""

from __future__ import annotations

import threading
import time
from itertools import chain

import numpy as np

from ._vec import BYTE, U, same_spans, span_hash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


def chunk_starts(buf: np.ndarray, off: np.ndarray, stops: bool = True) -> np.ndarray:
    """Chunk starts: rows' starts, each ASCII space byte after a byte that is surely
    not white space and, with ``stops``, each of ``.,;:!?`` after a letter.

    Bytes from 0x80 may belong to a wide white-space character; only two-byte
    characters led by 0xC3 (Latin-1) are known not to, and all of them but the
    signs for times and divided by are letters.
    """
    n = len(buf)
    first = np.zeros(n + 1, bool)
    first[off] = True
    if n > 1:
        sp = _SPACE[buf]
        latin = np.zeros(n, bool)
        latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80)
        first[1:n] |= sp[1:] & (~sp & (buf < 0x80) | latin)[:-1]
        if stops:
            first[1:n] |= _STOP[buf[1:]] & (_LETTER[buf] | latin & (buf != 0x97) & (buf != 0xB7))[:-1]
    return np.flatnonzero(first[:n])


#: Bytes of chunks from which a memo begins anew.
MOST_BYTES = 64 << 20


class Memo:
    """hash -> (place, length) in one flat uint32 array; sorted runs, bounded to ``limit`` chunks.

    Chunks' bytes are kept beside their ids and compared before ids are used, so equal hashes alone give nothing.
    """

    def __init__(self, encode, limit: int = 3_000_000, starts=chunk_starts):
        self.encode, self.limit, self.starts, self.used = encode, limit, starts, time.monotonic()
        self.clear()

    def clear(self) -> None:
        self.big = (np.zeros(0, U), np.zeros(0, np.int64))
        self.new = (np.zeros(0, U), np.zeros(0, np.int64))
        self.at, self.ids, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0
        self.from_, self.bytes = np.zeros(1 << 16, np.int64), np.zeros(1 << 20, np.uint8)

    def _add(self, hashes: np.ndarray, chunks: list[bytes]) -> np.ndarray:
        found = self.encode([x.decode("utf-8", "replace") for x in chunks])
        self.ids, self.at = self._put(self.ids, self.at, [len(x) for x in found], np.fromiter(chain.from_iterable(found), np.uint32))
        raw = np.frombuffer(b"".join(chunks), np.uint8)
        self.bytes, self.from_ = self._put(self.bytes, self.from_, [len(x) for x in chunks], raw)
        index = np.arange(self.n, self.n + len(found))
        self.n += len(found)
        self.new = self._merged(self.new, (hashes, index))
        if len(self.new[0]) * 4 > len(self.big[0]):
            self.big, self.new = self._merged(self.big, self.new), (np.zeros(0, U), np.zeros(0, np.int64))
        return index

    def _put(self, flat: np.ndarray, ends: np.ndarray, sizes: list[int], new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Append spans to a flat array and their ends to the table of ends; both grow by doubling."""
        used, n = int(ends[self.n]), self.n
        if used + len(new) > len(flat):
            flat = np.concatenate((flat, np.zeros(max(used + len(new), len(flat)), flat.dtype)))
        if n + len(sizes) + 1 > len(ends):
            ends = np.concatenate((ends, np.zeros(max(len(sizes) + 1, len(ends)), np.int64)))
        flat[used : used + len(new)] = new
        ends[n + 1 : n + 1 + len(sizes)] = used + np.cumsum(np.array(sizes, np.int64))
        return flat, ends

    def _same(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, index: np.ndarray) -> bool:
        """Whether the spans have the bytes of the chunks that their hashes found."""
        return bool((ends - starts == self.from_[index + 1] - self.from_[index]).all()) and same_spans(buf, starts, ends, self.bytes, self.from_[index])

    @staticmethod
    def _merged(a, b):
        h, i = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        order = np.argsort(h, kind="stable")
        return h[order], i[order]

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        for known, index in (self.big, self.new):
            if len(known):
                p = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[p] == h
                out[hit] = index[p[hit]]
        return out

    def texts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows (uint32) and each row's offsets (n + 1)."""
        self.used = time.monotonic()
        if self.n > self.limit or self.from_[self.n] > MOST_BYTES:
            self.clear()
        starts = self.starts(buf, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        ends = np.append(starts[1:], len(buf))
        u, first, inverse = np.unique(span_hash(buf, starts, ends), return_index=True, return_inverse=True)
        index = self._find(u)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            raw = buf.tobytes()
            index[missing] = self._add(u[missing], [raw[a:b] for a, b in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist())])
        if not self._same(buf, starts, ends, index[inverse]):  # chunks that share a hash: this slice goes without the memo
            raw = buf.tobytes()
            found = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())])
            total = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(total[-1])), total[np.searchsorted(starts, off)]
        place, size = self.at[index][inverse], (self.at[index + 1] - self.at[index])[inverse]
        total = np.concatenate(([0], np.cumsum(size)))
        gather = np.arange(total[-1]) + np.repeat(place - total[:-1], size)
        return self.ids[gather], total[np.searchsorted(starts, off)]


_OPEN: dict = {}
#: Seconds after its last use at which a worker's memo goes, with its tokenizer; a task that still has it keeps it.
IDLE = 3.0


def _drop_idle(key: tuple, memo: Memo) -> None:
    while (left := memo.used + IDLE - time.monotonic()) > 0:
        time.sleep(left)
    _OPEN.pop(key, None)


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def row_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whole texts as chunks, for tokenizers whose added tokens may reach over white space."""
    return np.unique(off[:-1][off[:-1] < len(buf)])


def hf_memo(path: str, special: bool = True) -> Memo:
    """One memo per worker and tokenizer file; ids are those of the library's ``encode(text, add_special_tokens=False)``.

    ``special``: a special token's text inside a text becomes its id, as the
    library does by itself; otherwise it is ordinary text.  A chunk of letters
    alone is one pre-token, so the tokenizer's model encodes it directly; any
    other chunk takes the whole tokenizer.
    """
    if (found := _OPEN.get((path, special))) is None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = not special
        folds, tokenize, chars = t.normalizer is not None, t.model.tokenize, dict(enumerate(_byte_chars()))
        added = t.get_added_tokens_decoder().values()
        inside = all(not (x.lstrip or x.rstrip or x.content.isalpha() or set(x.content) & set(" \t\n\x0b\x0c\r.,;:!?")) for x in added)

        def one(s: str) -> list[int]:
            return [x.id for x in tokenize(s.encode().decode("latin-1").translate(chars))]

        def encode(chunks: list[str]) -> list[list[int]]:
            out: list = [None] * len(chunks)
            rest = []
            for i, s in enumerate(chunks):
                body = s[1:] if s[0] in " \n" else s
                if inside and body.isalpha() and (body.isascii() or max(body) < "\u0130"):
                    if folds:
                        out[i] = one(body.lower())
                    elif s[0] == "\n":
                        out[i] = one("\n") + one(body)
                    else:
                        out[i] = one(s)
                else:
                    rest.append(i)
            for i, x in zip(rest, t.encode_batch([chunks[i] for i in rest], add_special_tokens=False)):
                out[i] = x.ids
            return out

        found = _OPEN[path, special] = Memo(encode, starts=chunk_starts if inside else row_starts)
        threading.Thread(target=_drop_idle, args=((path, special), found), daemon=True).start()
    found.used = time.monotonic()
    return found
