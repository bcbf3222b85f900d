"""Operator 1, token counts: count-only Viterbi.

An Aho-Corasick automaton enumerates the unigram vocabulary's matches that end
at each character; dynamic programming carries the best score and the number of
pieces, never the pieces.  Ties go to the longest last piece, as a forward search
does that keeps the first of equal candidates by start.  The segmentation is the
one of the best score; the library's ``encode`` takes another on some words (see
the README).
Unknown characters cost the lowest score less 10 and count as one piece per
UTF-8 byte where the vocabulary has byte pieces, else a run of them as one.

No piece of such a vocabulary has a space mark after another character, so texts
fall into chunks that are solved once per worker and distinct chunk.  Scores are
added exactly within a chunk; the library adds 32-bit floats over the whole
text, which for texts of thousands of words rounds and may break a tie otherwise.

Null and empty texts have 0 tokens; one result row per input row.  An empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._vec import text_slices
from .token_memo import Memo

MARK = "▁"


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes = any(sp.is_byte(i) for i in range(n))
        self.unknown = min(self.scores.values()) - 10
        self.splits = all(MARK not in p.lstrip(MARK) for p in self.scores)
        self.lines = not any("\n" in p for p in self.scores)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, s in self.scores.items():
            a.add_word(p, (len(p), s))
        a.make_automaton()
        return a


def viterbi_count(automaton, vocabulary: Vocabulary, text: str) -> int:
    """Pieces of the best segmentation of ``text`` (spaces already marked)."""
    n, unknown, by_byte = len(text), vocabulary.unknown, vocabulary.bytes
    score, count, was_unknown = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
    matches: list = [()] * n
    for end, hit in automaton.iter(text):
        matches[end] = (*matches[end], hit)
    for end in range(n):
        best, pieces, single, flag = None, 0, False, False
        for size, s in sorted(matches[end], reverse=True) if len(matches[end]) > 1 else matches[end]:
            single |= size == 1
            x = score[end + 1 - size] + s
            if best is None or x > best:
                best, pieces = x, count[end + 1 - size] + 1
        if not single:
            x = score[end] + unknown
            if best is None or x > best:
                cost = len(text[end].encode()) if by_byte else 0 if was_unknown[end] else 1
                best, pieces, flag = x, count[end] + cost, True
        score[end + 1], count[end + 1], was_unknown[end + 1] = best, pieces, flag
    return count[n]


def _starts(lines: bool):
    def starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(buf)
        first = np.zeros(n + 1, bool)
        first[off] = True
        if n > 1:
            sp = buf == 32
            first[1:n] |= sp[1:] & ~sp[:-1]
            if lines:
                nl = buf == 10
                first[:n] |= nl
                first[1:n] |= nl[:-1]
        return np.flatnonzero(first[:n])

    return starts


_OPEN: dict = {}


def _memo(path: str) -> Memo:
    if path not in _OPEN:
        v = Vocabulary(path)
        a = v.automaton()
        whole = lambda buf, off: off[:-1][off[:-1] < off[1:]]
        _OPEN[path] = Memo(lambda chunks: [[viterbi_count(a, v, c.replace(" ", MARK))] for c in chunks], starts=_starts(v.lines) if v.splits else whole)
    return _OPEN[path]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its number of tokens and of characters."""
    picked = docs.select(F.col(id_col), F.col(text_col))

    def run(batches):
        memo = _memo(model)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            marked = pc.binary_join_element_wise(" ", text, "")  # the tokenizer's mark before a text
            for a, b, buf, off in text_slices(marked):
                each, at = memo.texts(buf, off)
                sums = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
                rows = text.slice(a, b - a)
                chars = pc.utf8_length(rows).cast(pa.int64())
                n = np.where(chars.to_numpy(zero_copy_only=False) > 0, sums[at[1:]] - sums[at[:-1]], 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), chars], [id_col, "n_tokens", "n_chars"])

    return picked.mapInArrow(run, f"`{id_col}` {picked.dtypes[0][1]}, n_tokens long, n_chars long")


def query(spark, sf_dir):
    import public_tokenizers

    from ._io import table

    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
