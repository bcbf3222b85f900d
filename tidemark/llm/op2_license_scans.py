"""Operator 2, license scans: template-markup matching.

A template is wording with two kinds of markup: ``[[ ... ]]`` encloses optional
wording and ``{{n}}`` stands for up to n replaceable words.  It is compiled to an
automaton over word hashes; a text is accepted where all mandatory wording
matches exactly, word for word.  Only places where a word stands that a
template may open with are tried (all places, if it may open with any word), and they are found with numpy.

Base phrases are templates without markup; every place counts.  Nulls and empty
texts have no words and no labels.  One result row per input row.  A text of any
length is matched whole; of wordings that are accepted from one place the longest
counts.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._vec import BYTE_LOWER, row_starts, text_slices, words

#: Letters after lower-casing A-Z, digits, and all bytes from 0x80.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = True
WORD[0x80:] = True

#: Phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and licence wording with markup.
TEMPLATES = (
    ("apache-2.0", "licensed under [[the]] apache license [[version]] 2 0"),
    ("apache-2.0", "apache license version 2 0 {{2}} http www apache org licenses"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted [[provided that the following conditions are met]]"),
    ("bsd", "released under the {{3}} bsd license"),
    ("cc-by", "licensed under [[a]] [[the]] creative commons attribution [[4 0]] [[international]] license"),
    ("cc-by-nc", "cc by nc [[{{1}} 0]]"),
    ("cc-by-sa", "cc by sa [[{{1}} 0]]"),
    ("copyright", "copyright [[c]] {{4}} all rights reserved"),
    ("gpl", "gnu [[lesser]] [[affero]] general public license [[as published by the free software foundation]] [[either version {{1}} [[of the license]]]]"),
    ("mit", "released under [[the]] mit license"),
    ("mit", "licensed under [[the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mpl-2.0", "mozilla public license [[version]] [[v]] 2 0"),
    ("spdx", "spdx license identifier {{3}}"),
)


def tokens(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8)
    return words(b, np.array([0, len(b)]), WORD, BYTE_LOWER)[3]


class Template:
    """States 0..end; ``lit`` moves on one word, ``free`` on any word, ``skip`` on none."""

    def __init__(self, label: str, markup: str):
        import re

        self.label = label
        self.lit: dict[int, list[tuple[int, int]]] = {}
        self.free: dict[int, list[int]] = {}
        self.skip: dict[int, list[int]] = {}
        self.n, self.mandatory, opened = 0, 0, []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
            if part == "[[":
                opened.append(self.n)
            elif part == "]]":
                self.skip.setdefault(opened.pop(), []).append(self.n)
            elif part[0] == "{":
                first, count = self.n, int(part[2:-2])
                for i in range(count):
                    self.free.setdefault(self.n, []).append(self.n + 1)
                    self.n += 1
                for i in range(first, first + count):
                    self.skip.setdefault(i, []).append(self.n)
            else:
                self.lit.setdefault(self.n, []).append((int(tokens(part)[0]), self.n + 1))
                self.n += 1
                self.mandatory += not opened
        first = self.closure({0})
        self.starts = {x for s in first for x, _ in self.lit.get(s, ())}
        self.any = any(s in self.free for s in first)

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, h: list[int], at: int, end: int) -> int:
        """Words of the longest match that starts at ``at``; 0 if there is none."""
        states, best, i = self.closure({0}), 0, at
        while states and i < end:
            w = h[i]
            states = self.closure({t for s in states for x, t in self.lit.get(s, ()) if x == w} | {t for s in states for t in self.free.get(s, ())})
            i += 1
            if self.n in states:
                best = i - at
        return best


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates=TEMPLATES) -> DataFrame:
    """One row per document: base phrase places, labels of phrases and templates, and a score from 0 to 1.

    score: 1 if a template accepts, else one half if only a base phrase stands there, else 0.
    ``template_words`` is the length of the longest accepted wording.
    """
    phrases = PHRASES if phrases is None else phrases
    picked = docs.select(F.col(id_col), F.col(text_col))
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "template_words"]
    schema = f"`{id_col}` {picked.dtypes[0][1]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, template_words long"

    def run(batches):
        plain = [(tokens(p), label) for p, label in phrases.items()]
        autos: dict[int, list[Template]] = {}
        anywhere = []
        for label, markup in templates:
            t = Template(label, markup)
            if t.any:
                anywhere.append(t)
                continue
            for x in t.starts:
                autos.setdefault(x, []).append(t)
        starts = np.array(sorted(autos), np.uint64)
        for batch in batches:
            for a, b, buf, off in text_slices(batch.column(1)):
                n = b - a
                _, _, row, h = words(buf, off, WORD, BYTE_LOWER)
                n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                found: dict[int, set[str]] = {}
                more: dict[int, set[str]] = {}
                longest = np.zeros(n, np.int64)
                for p, label in plain:
                    k = len(p)
                    if len(h) < k:
                        continue
                    hit = row_starts(row, k)
                    for i in range(k):
                        hit &= h[i : len(h) - k + 1 + i] == p[i]
                    at = np.flatnonzero(hit)
                    r = np.searchsorted(row, at, "right") - 1
                    n_base += np.bincount(r, minlength=n)
                    np.minimum.at(first, r, at - row[r])
                    np.maximum.at(last, r, at - row[r])
                    for i in set(r.tolist()):
                        found.setdefault(i, set()).add(label)
                at = np.arange(len(h)) if anywhere else np.flatnonzero(np.isin(h, starts))
                every = h.tolist() if len(at) else []
                rows = np.searchsorted(row, at, "right") - 1
                for i, r in zip(at.tolist(), rows.tolist()):
                    end = int(row[r + 1])
                    for t in [*autos.get(every[i], ()), *anywhere]:
                        if size := t.match(every, i, end):
                            more.setdefault(r, set()).add(t.label)
                            longest[r] = max(longest[r], size)
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n), pa.array(np.diff(row)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                        pa.array([",".join(sorted(found.get(i, ()))) for i in range(n)], pa.string()),
                        pa.array([",".join(sorted(found.get(i, set()) | more.get(i, set()))) for i in range(n)], pa.string()),
                        pa.array([1.0 if i in more else 0.5 if i in found else 0.0 for i in range(n)], pa.float64()), pa.array(longest),
                    ],
                    names,
                )

    return picked.mapInArrow(run, schema)


def query(spark, sf_dir):
    from ._io import table

    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
