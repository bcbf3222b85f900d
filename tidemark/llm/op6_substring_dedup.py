"""Operator 6, substring dedup: suffix automata of reference shards.

The reference is the corpus itself, so its automata cannot be broadcast whole
within any bound.  References are cut into shards by anchor (see ``_repeats``):
strings that can share a window of ``length`` words have the same anchor, and
both the reference and the streamed strings go to that shard.  A shard's
generalised suffix automaton is built from its reference strings in document
order, each state with the first place where it ends; the strings are then
streamed through it, and the matching statistics tell where each window of
``length`` words first stands.  Windows that also start earlier are removed.

Order: by id, then start; null ids last; rows of one id and different texts by
the hash of the text; fully repeated rows are one document.  Nulls are empty;
texts of fewer than ``length`` words lose nothing; a text of any length is cut
into strings of at most ``2 * length - k`` words.  An empty table gives an empty
result; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._io import quoted, with_ref
from ._repeats import HOT, Units, covered, repeated_windows
from ._vec import NOT_SPACE, spans, text_slices


class SuffixAutomaton:
    """Generalised over several strings; ``first`` is the number of the place where a state first ended."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]

    def _state(self, size: int, first: int, moves: dict, link: int) -> int:
        self.size.append(size)
        self.first.append(first)
        self.next.append(moves)
        self.link.append(link)
        return len(self.size) - 1

    def add(self, string, place: int) -> None:
        """Append a string whose units end at ``place``, ``place`` + 1, ..."""
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for ch in string:
            q = nxt[last].get(ch)
            if q is not None and size[q] == size[last] + 1:
                last = q
                place += 1
                continue
            if q is not None:
                cur = self._clone(last, ch, q)
                last = cur
                place += 1
                continue
            cur = self._state(size[last] + 1, place, {}, 0)
            p = last
            while p != -1 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][ch]
                link[cur] = q if size[q] == size[p] + 1 else self._clone(p, ch, q)
            last = cur
            place += 1

    def _clone(self, p: int, ch, q: int) -> int:
        nxt, link = self.next, self.link
        clone = self._state(self.size[p] + 1, self.first[q], dict(nxt[q]), link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(ch) == q:
            nxt[p][ch] = clone
            p = link[p]
        return clone

    def matches(self, string):
        """Matching statistics: after each unit, the length matched and the state."""
        state, n = 0, 0
        nxt, link, size = self.next, self.link, self.size
        for ch in string:
            while state and ch not in nxt[state]:
                state = link[state]
                n = size[state]
            if ch in nxt[state]:
                state = nxt[state][ch]
                n += 1
            yield n, state


def solver(length: int):
    def solve(cols: dict, content: list[bytes]) -> list:
        """Strings come sorted by anchor, then document and place: the order of the reference."""
        out: list = [None] * len(content)
        h = cols["h"]
        cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))).tolist()
        for i, j in zip(cut, cut[1:]):
            if j - i == 1:
                continue  # a reference of one string holds nothing earlier
            strings = [np.frombuffer(x, "<u8").tolist() for x in content[i:j]]
            automaton, at, begins = SuffixAutomaton(), 0, []
            for s in strings:
                begins.append(at)
                automaton.add(s, at)
                at += len(s)
            link, size, first = automaton.link, automaton.size, automaton.first
            for k, s in enumerate(strings):
                mask = np.zeros(len(s) - length + 1, bool)
                for e, (n, state) in enumerate(automaton.matches(s)):
                    if n >= length and e >= length - 1:
                        while size[link[state]] >= length:
                            state = link[state]
                        mask[e - length + 1] = first[state] < begins[k]
                out[i + k] = mask
        return out

    return solve


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, k: int = 5, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """id, n_words, n_removed, kept_sha256; ``with_text`` adds the kept words joined by one space."""
    kind = docs.select(F.col(quoted(id_col))).dtypes[0][1]
    keyed = with_ref(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), "id", "text")
    ranged = repeated_windows(keyed, Units("word", length, k), solver(length), first_stays=True, hot=hot).select("id", "text", "_ranges")
    schema = f"{quoted(id_col)} {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def run(batches):
        for batch in batches:
            parts = batch.column(2)
            for a, b, buf, off in text_slices(batch.column(1)):
                s, e, row = spans(buf, off, NOT_SPACE)
                raw, n = buf.tobytes(), b - a
                removed, kept = [0] * n, []
                for i, x in enumerate(parts.slice(a, n)):
                    f, t = int(row[i]), int(row[i + 1])
                    si, ei = s[f:t], e[f:t]
                    if x.is_valid and len(x):
                        gone = covered(x.as_py(), length, t - f)
                        removed[i] = int(gone.sum())
                        si, ei = si[~gone], ei[~gone]
                    kept.append(b" ".join([raw[p:q] for p, q in zip(si.tolist(), ei.tolist())]))
                out = [batch.column(0).slice(a, n), pa.array(np.diff(row), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                if with_text:
                    out.append(pa.array([x.decode("utf-8", "replace") for x in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [id_col, "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])

    return ranged.mapInArrow(run, schema)


def query(spark, sf_dir):
    from ._io import table

    return dedup_windows(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM texts),
windows AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM windows WHERE n > 1),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)
"""
