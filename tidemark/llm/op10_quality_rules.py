"""Operator 10, quality rules: line-first cleaning.

Every line is judged alone by punctuation, navigation and boilerplate rules;
failed lines are removed, and a document that loses more than ``max_lost`` of its
word characters, or keeps too few words, is rejected.

Nulls and empty texts have no lines and are rejected (fewer than ``min_words``).
Null ids and repeated rows pass through, one result row per input row; of equal
lines in a text the first stays.  Texts of any length are judged whole, in slices
that bound memory.  An empty table gives an empty result.  Extra columns of any
name are ignored by :func:`score_quality` and kept by :func:`filter_quality`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._io import packed_rows, unpacked_rows
from ._vec import BYTE_LOWER, NOT_SPACE, counts_within, lut, ngrams, row_starts, span_hash, spans, text_slices, union_length, words

_SYMBOL = lut(b"#*$%&|<>")
_NEWLINE = ~lut(b"\n")
_ALPHA = lut(bytes(range(65, 91)) + bytes(range(97, 123))) | (np.arange(256) >= 128)
_UPPER = lut(bytes(range(65, 91)))
_SHOUT = lut(b"!?")
_BAR = lut(b"|>")
_CLOSE = lut(b".!?:;,\"')]")
#: Closing marks beyond ASCII.
CLOSING = "…»”’。！？"
#: Lower-case words that open or fill navigation lines.
NAVIGATION = ("home", "menu", "login", "logout", "register", "search", "sitemap", "contact", "about", "help", "next", "previous", "share", "subscribe", "facebook", "twitter", "cart", "privacy", "terms")
#: Phrases of boilerplate lines.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "powered by", "click here", "sign up", "read more", "subscribe to our newsletter", "accept cookies")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bad_lines long, lost_share double, base_failed boolean, kept boolean"
#: Words from which a line may end without a closing mark: it is a paragraph that was cut, not a heading or a menu.
SHORT = 12
_PLAIN = _ALPHA | lut(b"0123456789")


def _phrase_hashes(phrases) -> dict[int, np.ndarray]:
    by: dict[int, list[int]] = {}
    for p in phrases:
        b = np.frombuffer(p.encode(), np.uint8)
        h = words(b, np.array([0, len(b)]), _PLAIN, BYTE_LOWER)[3]
        by.setdefault(len(h), []).append(int(ngrams(h, len(h))[0]))
    return {n: np.array(sorted(x), np.uint64) for n, x in by.items()}


_NAV, _BOILER = _phrase_hashes(NAVIGATION)[1], _phrase_hashes(BOILERPLATE)


def measure(buf: np.ndarray, off: np.ndarray, min_words: int, max_repeat: int, max_lost: float, window: int = 8) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The columns of SCHEMA for a slice, and its lines: starts, ends, failed."""
    n = len(off) - 1
    cum = lambda m: np.concatenate(([0], np.cumsum(m)))
    ws, we, wrow, wh = words(buf, off)
    n_words = np.diff(wrow)
    is_word = NOT_SPACE[buf]
    lead = cum(is_word & ((buf & 0xC0) != 0x80))
    symbols = cum(_SYMBOL[buf])
    ls, le, lrow = spans(buf, off, _NEWLINE)
    line_row = np.repeat(np.arange(n), np.diff(lrow))
    line_words = np.searchsorted(ws, le) - np.searchsorted(ws, ls)
    has_word = line_words > 0
    lh = span_hash(buf, ls, le)
    # a line that equals an earlier one of its row: all but the first of each (row, hash)
    order = np.lexsort((np.arange(len(lh)), lh, line_row))
    again = np.zeros(len(lh), bool)
    if len(lh) > 1:
        again[order[1:]] = (lh[order[1:]] == lh[order[:-1]]) & (line_row[order[1:]] == line_row[order[:-1]])
    again &= has_word
    g = ngrams(wh, window)
    starts = np.flatnonzero(row_starts(wrow, window)) if len(g) else np.zeros(0, np.int64)
    starts = starts[counts_within(np.searchsorted(wrow, starts, "right"), g[starts])] if len(starts) else starts
    covered = cum(union_length(starts, window, len(wh)))
    # line rules
    part = lambda c: c[le] - c[ls]
    chars, alpha, upper = part(lead), part(cum(_ALPHA[buf] & ((buf & 0xC0) != 0x80))), part(cum(_UPPER[buf]))
    shouts, bars, sym = part(cum(_SHOUT[buf])), part(cum(_BAR[buf] | (buf == 0xBB) & (np.concatenate(([0], buf[:-1])) == 0xC2))), part(symbols)
    noisy = (sym * 5 > 2 * line_words) & (sym >= 2) | (alpha * 2 < chars) | (shouts * 2 > line_words) & (line_words >= 4)
    loud = (upper * 10 > 7 * np.maximum(alpha, 1)) & (line_words >= 6)
    ps, pe, _ = spans(buf, off, _PLAIN)
    ph = span_hash(buf, ps, pe, BYTE_LOWER)
    first_plain, end_plain = np.searchsorted(ps, ls), np.searchsorted(ps, le)
    nav = cum(np.isin(ngrams(ph, 1), _NAV))
    nav = nav[end_plain] - nav[first_plain]
    navigation = (bars >= 2) & (line_words <= 4 * (bars + 1)) | (nav * 2 > line_words)
    boiler = np.zeros(len(ls), bool)
    for k, wanted in _BOILER.items():
        at = np.flatnonzero(np.isin(ngrams(ph, k), wanted))
        at_line = np.searchsorted(ls, ps[at], "right") - 1
        boiler[at_line[pe[np.minimum(at + k - 1, len(pe) - 1)] <= le[at_line]]] = True
    boiler &= line_words <= 15
    wfirst, wend = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    unended = np.zeros(len(ls), bool)
    at = np.flatnonzero(has_word & (line_words < SHORT))
    tail = we[wend[at] - 1]
    closed = _CLOSE[buf[tail - 1]]
    for mark in CLOSING:
        m = mark.encode()
        ok = tail >= len(m)
        for i, x in enumerate(m):
            ok &= buf[np.maximum(tail - len(m) + i, 0)] == x
        closed |= ok
    unended[at[~closed]] = True
    echo = cum(np.concatenate(([False], wh[1:] == wh[:-1]))[: len(wh)])
    stutter = (echo[wend] - echo[np.minimum(wfirst + 1, wend)]) * 2 > line_words
    failed = has_word & (again | noisy | loud | unended | navigation | boiler | stutter)
    by_row = lambda v: np.bincount(line_row, v, n)
    word_chars = lead[off[1:]] - lead[off[:-1]]
    lost = by_row(chars * failed) / np.maximum(word_chars, 1)
    left = n_words - by_row(line_words * failed)
    repeat = covered[wrow[1:]] - covered[wrow[:-1]]
    base = (n_words < min_words) | (100 * repeat > max_repeat * n_words)
    kept = ~base & (lost <= max_lost) & (left >= min_words)
    cols = [n_words, word_chars, symbols[off[1:]] - symbols[off[:-1]], by_row(again).astype(np.int64), repeat, by_row(has_word).astype(np.int64), by_row(failed).astype(np.int64), lost, base, kept]
    return cols, ls, le, failed


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, max_repeat: int = 30, max_lost: float = 0.4, with_text: bool = False) -> DataFrame:
    """One row per document with its measures and verdict; ``with_text`` adds ``clean_text``, the lines that passed."""
    picked = docs.select(F.col(id_col), F.col(text_col))
    schema = f"`{id_col}` {picked.dtypes[0][1]}, {SCHEMA}" + ", clean_text string" * with_text

    def run(batches):
        kinds = [pa.int64()] * 7 + [pa.float64(), pa.bool_(), pa.bool_()]
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(1)):
                cols, ls, le, failed = measure(buf, off, min_words, max_repeat, max_lost)
                out = [batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(cols, kinds))]
                if with_text:
                    out.append(pa.array(_without(buf, off, ls, le, failed), pa.string()))
                yield pa.RecordBatch.from_arrays(out, [id_col, *(x.split()[0] for x in SCHEMA.split(", ")), *["clean_text"] * with_text])

    return picked.mapInArrow(run, schema)


def _without(buf: np.ndarray, off: np.ndarray, ls: np.ndarray, le: np.ndarray, failed: np.ndarray) -> list[str]:
    """The texts of a slice without their failed lines; a text that loses none is as it was."""
    gone = np.zeros(len(buf) + 1, np.int32)
    ends = le[failed] + (np.append(buf, 10)[le[failed]] == 10)  # with their line end, which may be the row's end
    row_end = off[np.searchsorted(off, ls[failed], "right")]
    np.add.at(gone, ls[failed], 1)
    np.add.at(gone, np.minimum(ends, row_end), -1)
    keep = np.cumsum(gone[:-1]) == 0
    raw, at = buf[keep].tobytes(), np.concatenate(([0], np.cumsum(keep)))[off].tolist()
    return [raw[i:j].decode("utf-8", "replace") for i, j in zip(at, at[1:])]


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clean: bool = False, **rules) -> DataFrame:
    """The documents that pass, with all their columns, in one pass over the texts; ``clean`` takes the failed lines out of their texts."""
    min_words, max_repeat, max_lost = rules.get("min_words", 20), rules.get("max_repeat", 30), rules.get("max_lost", 0.4)
    rows = packed_rows(docs, id_col, text_col).drop("id")

    def run(batches):
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(1)):
                cols, ls, le, failed = measure(buf, off, min_words, max_repeat, max_lost)
                part = batch.slice(a, b - a)
                if clean:
                    made = pa.array(_without(buf, off, ls, le, failed), pa.string())
                    part = pa.RecordBatch.from_arrays([part.column(0), made], ["row", "text"])
                yield part.filter(pa.array(cols[-1], pa.bool_()))

    return unpacked_rows(rows.mapInArrow(run, rows.schema), docs.columns, text_col, [])


def query(spark, sf_dir):
    """doc_id, base measures, base_failed and kept of all ``documents``."""
    from ._io import table

    return score_quality(table(spark, sf_dir, "documents", "doc_id", "text"))
