"""Operators 11 to 13 against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import op11_exact_topk as op11, op12_collocations as op12, op13_fill_in_middle as op13

DOCS = "doc_id long, text string, lang string, id int, word string, gram int, row int, marked string"


# operator 11


def _brute_top(rows, queries, k, scale=256):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    held = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    asked = {(i, tuple(v)) for i, v in queries if i is not None and ok(v)}
    out = []
    for i, v in asked:
        q = [math.floor(scale * x) for x in v]
        long = lambda x: min(max(x, -(2**63)), 2**63 - 1)
        scores = sorted((-long(sum(a * b for a, b in zip(q, w))), j) for j, w in held if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def _rows(found):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


@pytest.mark.parametrize("many", [False, True])
def test_top_k(spark, monkeypatch, many):
    r = random.Random(3)
    rows = [(i, [float(r.choice([0, 0, r.uniform(-1, 1)])) for _ in range(12)]) for i in range(300)]
    rows += [(300, []), (301, None), (302, [1.0, None]), (303, [float("nan")]), (304, [float("inf")]), (None, [1.0]), (305, [0.5, 0.25]), (50, [1.0] * 12)]
    rows += [(310 + i, [0.5] * 12) for i in range(40)] + [(400, [0.75] * 12)] * 30  # ties, and one row very often
    if many:  # several blocks of queries and of candidates
        monkeypatch.setattr(op11, "QUERY_VALUES", 60)
        monkeypatch.setattr(op11, "CANDIDATE_VALUES", 400)
        monkeypatch.setattr(op11, "SCORES", 90)
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "vec_id long, embedding array<double>, copies int, cell string").repartition(3)
    assert _rows(op11.top_k(df.where("vec_id % 50 = 0"), df)) == _brute_top(rows, [x for x in rows if x[0] is not None and x[0] % 50 == 0], 5)


def test_top_k_of_large_numbers(spark):
    """Sums beyond 2**24, 2**53 and 64 bits."""
    for big in (1e3, 1e7, 1e15, 1e200):
        rows = [(i, [big * (i + 1), -big / 3, float(i)]) for i in range(12)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert _rows(op11.top_k(df.where("vec_id < 4"), df, k=3)) == _brute_top(rows, rows[:4], 3), big


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert _rows(op11.top_k(df.where("vec_id = 0"), df)) == [(0, 1, 1, 256 * 512)]
    assert op11.top_k(df.limit(0), df).count() == 0 and op11.top_k(df, df.limit(0)).count() == 0


def test_top_k_terms():
    """A term's weights go to the candidates that have it, whether few or most of them do."""
    import numpy as np

    r = np.random.default_rng(1)
    q, c = r.integers(-3, 4, (7, 9)) * (r.random((7, 9)) < 0.5), r.integers(-3, 4, (40, 9)) * (r.random((40, 9)) < r.random(9))
    assert (op11.accumulate(q.astype(float), op11.postings(c.astype(float)), 40) == q @ c.T).all()


# operator 12


def _brute_phrases(rows, least, cover, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        covered = {g[i : i + k] for g, a in cand.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= cover * cand[g[i : i + k]]}
        best = []
        for g, a in cand.items():
            if g not in covered:
                score, k = min((2000000 * a // (count[g[:k]] + count[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), count[g[:k]], count[g[k:]]))
        out += [(lang, i, p.decode(), -a, lf, rf, n[lang], -s) for i, (s, a, p, lf, rf) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def _phrases(df, **kw):
    return sorted(tuple(r) for r in op12.collocations(df, **kw).collect())


@pytest.fixture(scope="module")
def talk():
    r = random.Random(11)
    letters = "abcdefgh"
    rows = [(r.choice(["en", "de", None]), "".join(r.choice(letters) + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(r.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, " \t,. "), ("en", "a a a a a a a"), ("en", "A b C d. a B c D"), ("x", "é ü é ü"), ("x", "É ü é ü é ü"), ("und", "a b"), ("en", "a" * 5000 + " b" * 300)]
    return rows + [("de", "f g h f g h, a")] * 25


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 150, "part": 7, "split": 4}])
@pytest.mark.parametrize("least, cover", [(2, 80), (5, 50), (30, 80)])
def test_collocations(spark, talk, sizes, least, cover):
    df = spark.createDataFrame([(i, t, lang, 1, "w", 2, 3, "m") for i, (lang, t) in enumerate(talk)], DOCS).repartition(3)
    assert _phrases(df, least=least, cover=cover, top=40, **sizes) == _brute_phrases(talk, least, cover, 40)


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert _phrases(df) == [] and op12.collocations(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert _phrases(spark.createDataFrame([(1, "one, two", "en", 1, "w", 2, 3, "m")], DOCS)) == []


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_long_texts_in_steps(step):
    import numpy as np

    r = random.Random(step)
    text = "".join(r.choice(["a", "bc", "é", " ", "\t", ".", "\n", " x "]) for _ in range(700)).encode()
    buf = np.frombuffer(text, np.uint8)
    whole, cut = (op12.pieces(buf, np.array([0, len(buf)]), k) for k in (len(buf), step))
    assert all((a == b).all() for a, b in zip(whole, cut))


def test_words_of_one_hash(monkeypatch):
    """Words are told apart by their bytes, not by their hashes."""
    import numpy as np

    monkeypatch.setattr(op12, "span_hash", lambda buf, s, e: np.zeros(len(s), np.uint64))
    buf = np.frombuffer(b"ab ba ab c", np.uint8)
    s, e, _ = op12.pieces(buf, np.array([0, len(buf)]))
    place, words, count = op12.dictionary(buf, s, e)
    assert words.to_pylist() == ["ab", "ba", "c"] and place.tolist() == [0, 1, 0, 2] and count.tolist() == [2, 1, 1]


def test_phrase_scores_are_exact(spark):
    """Products beyond 64 bits."""
    a, b = 6 * 10**17 + 1, 6 * 10**17 + 7
    found = spark.createDataFrame([([1, 2], a)], "gram array<long>, a long")
    vocab = spark.createDataFrame([(1, "en", "x", b), (2, "en", "y", b + 3)], "id long, lang string, word string, f long")
    got = op12.scored(found, vocab, 80).collect()
    assert [(r.phrase, r.l, r.r, r.score) for r in got] == [("x y", b, b + 3, 2000000 * a // (2 * b + 3))]


def test_collocations_query(spark, sf):
    from tidemark.llm import registry

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert sorted(tuple(r) for r in registry.queries()["op12_collocations"](spark, sf).collect()) == _brute_phrases(rows, 30, 80, 2000)


# operator 13


def _brute_middle(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, None, text
    if h4 % 100 < spm:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, " ", "a", " a b  c\n", "one <P> two", "<S>", "x<M", "P><S", "\x01\x02d \x02e\x01 \x02", "\x01" * 5, "é 日本 𝄞   x\u0085y", "a$0\\ $1 b", "< <P < <S> <", "w " * 500, "tab\t\x0b\x0c\rend \t", "z" * 100_000, "y \x1c z\x1fq", "<<<", ">P> S>"]


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 50), (100, 0), (0, 100)])
def test_fill_in_middle(spark, rate, spm):
    rows = [(20 * j + i, t, "en", 1, "w", 2, 3, "m") for j in range(6) for i, t in enumerate(TEXTS)] + [(-7, "a b c", "en", 1, "w", 2, 3, "m"), (None, "a b c d", "en", 1, "w", 2, 3, "m"), (None, None, None, None, None, None, None, None)] + [(5, "same row", "en", 1, "w", 2, 3, "m")] * 2
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    made = op13.fill_in_middle(df, rate=rate, spm=spm)
    assert made.columns[: len(df.columns)] == df.columns
    key = lambda x: tuple((v is None, v) for v in x)
    got = [tuple(r) for r in made.select("doc_id", "text", "n_units", "form", "prefix", "middle", "suffix", "output", op13.restore(F.col("output"), F.col("form")).alias("back")).collect()]
    want = [(r[0], r[1], *_brute_middle(r[0], r[1], 42, rate, spm), r[1] or "") for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fill_in_middle_columns(spark):
    """A column named as one that is made is replaced; an empty table stays empty."""
    df = spark.createDataFrame([(1, "a b", "old", 2)], "doc_id long, text string, output string, `odd``name` int")
    made = op13.fill_in_middle(df)
    assert made.columns == ["doc_id", "text", "odd`name", *op13.MADE] and made.first()["output"] != "old"
    assert op13.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("markers", [("", "b", "c"), ("a", "a", "c"), ("ab", "bc", "d"), ("aba", "x", "y"), ("ab", "xaby", "z")])
def test_markers_that_cannot_be_told_apart(spark, markers):
    with pytest.raises(ValueError):
        op13.fill_in_middle(spark.range(1).selectExpr("id doc_id", "'x' text"), markers=markers)


def test_fill_in_middle_is_native(spark, sf):
    from tidemark.llm import registry

    plan = registry.queries()["op13_fill_in_middle"](spark, sf)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
