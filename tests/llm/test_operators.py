"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import op1_token_counts as op1, op2_license_scans as op2, op3_token_ids as op3, op4_chat_formatting as op4, op5_suffix_array_dedup as op5
from tidemark.llm import op6_substring_dedup as op6, op7_ngram_jaccard_join as op7, op8_packing as op8, op9_benchmark_decontamination as op9, op10_quality_rules as op10

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# the extra column clashes with names that the operators use inside
SCHEMA = "doc_id long, text string, ref string, h int"


def _twin(letters):
    """1,024 letters; with the letters exchanged, any polynomial hash modulo 2**64 of them is the same."""
    return "".join(letters[bin(i).count("1") & 1] for i in range(1024))


def _texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)] + ["é", "naïve", "日本", "ok.", "x,"]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = make(150), make(60)
    near = base.split()
    near[40] = "changed"
    far = base.split()
    far[10] = far[50] = far[90] = far[130] = "other"
    long = make(4000)
    texts = [base, base, " ".join(near), " ".join(far), base.upper(), make(30) + "\n" + passage + "\n" + make(20), passage + " " + make(10), make(5), "", None, "a b c", "a b c", long, "same words " * 80, make(100), passage, "</s> <|endoftext|>", "  \t\n", make(19), make(20)]
    return texts


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "r", 1) for i, t in enumerate(_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null ids, ids that come twice, rows that come twice."""
    return spark.createDataFrame([*rows, (3, rows[3][1], "r", 1), (0, rows[5][1], "z", 2), (None, rows[0][1], "r", 1), (None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _get(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def _unigram(path):
    """The vocabulary read as a unigram model: only its type byte differs."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    m.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_token_counts(docs, odd, empty, rows):
    path = P.path("piece_bpe_32k.model")
    got = _get(op1.count_tokens(docs, path))
    v = op1.Vocabulary(path)
    a = v.automaton()
    for i, t, *_ in rows:  # whole texts at once, without chunks
        assert got[i].n_tokens == (op1.viterbi_count(a, v, (" " + t).replace(" ", op1.MARK)) if t else 0), i
    try:
        sp = _unigram(path)
    except ImportError:
        sp = None
    if sp:
        for i, t, *_ in rows:
            if t and len(t) < 500:
                assert got[i].n_tokens == len(sp.encode(t)), (i, t)
    assert op1.count_tokens(odd, path).count() == len(rows) + 4
    assert op1.count_tokens(empty, path).count() == 0


def test_viterbi_ties():
    class V:
        unknown, bytes = -100.0, True

    import ahocorasick

    a = ahocorasick.Automaton()
    for p, s in {"a": -1.0, "b": -1.0, "ab": -2.0, "c": -1.0, "bc": -2.0}.items():
        a.add_word(p, (len(p), s))
    a.make_automaton()
    assert op1.viterbi_count(a, V, "ab") == 1  # equal scores: the longest last piece
    assert op1.viterbi_count(a, V, "abc") == 2
    assert op1.viterbi_count(a, V, "é") == 2  # bytes of an unknown character


def test_licenses(spark, odd, empty):
    texts = ["All rights reserved. GNU General Public License v3", "x CC BY y cc-by-sa 4.0", "Copyright (c) 2020 Foo Bar. All Rights Reserved.", "Licensed under the Apache License, Version 2.0.", "licensed under that apache license", None, "ALL RIGHTS\nreserved all rights reserved"]
    got = _get(op2.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 0, 4, "gpl,reserved")
    assert got[1].base_labels == "cc-by" and got[1].labels == "cc-by,cc-by-sa"
    assert got[2].labels == "copyright,reserved" and got[3].labels == "apache-2.0" and got[3].score == 1.0
    assert got[4].labels == "" and got[4].first_word is None and got[5].n_words == 0
    assert got[6].n_base == 2 and got[6].last_word == 3
    assert op2.scan_licenses(odd).count() == odd.count() and op2.scan_licenses(empty).count() == 0


def test_long_and_open_templates(spark):
    """Templates of more than 128 words, and such that open with optional or replaceable words."""
    full = " ".join(f"w{i}" for i in range(400))
    templates = [("full", full), ("option", "[[the]] quick [[red]] fox"), ("free", "{{2}} lazy dog")]
    texts = ["x " + full + " y", full[:-4], "a quick fox", "the quick red fox", "so lazy dog", "lazy dog", "the fox"]
    got = _get(op2.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), phrases={}, templates=templates))
    assert [got[i].labels for i in range(7)] == ["full", "", "option", "option", "free", "free", ""]
    assert [got[i].template_words for i in range(7)] == [400, 0, 2, 4, 3, 2, 0]


def test_template_markup():
    t = op2.Template("x", "a [[b [[c]]]] {{2}} d")
    ids = {w: int(op2.tokens(w)[0]) for w in "abcdz"}
    go = lambda s: t.match([ids[w] for w in s], 0, len(s))
    assert [go(s) for s in ("ad", "abd", "abcd", "azzd", "abzd", "azzzd", "acd", "az")] == [2, 3, 4, 4, 4, 0, 3, 0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_memo_equals_tokenizer(name, rows):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidemark.llm._vec import text_slices
    from tidemark.llm.token_memo import hf_memo

    more = ["it's don't  x", "ÀÉ x×.y. ÷,z", "a.b,c;d:e!f?", "\n\nX\n y", "日本 語　 ok", "ſ ﬁ İx", "tab\t\tx \u0085 y"]
    texts = [t or "" for _, t, *_ in rows] + more
    t = Tokenizer.from_file(P.path(name))
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    got = []
    for _, _, buf, off in text_slices(pa.array(texts), 500):
        ids, at = hf_memo(P.path(name)).texts(buf, off)
        got += [ids[i:j].tolist() for i, j in zip(at, at[1:])]
    assert got == want


def _ids(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return [np.array([*x.ids, end], "<u4") for x in t.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, docs, odd, empty, rows, tmp_path):
    want = _ids("word_bpe_49k.json", [t or "" for _, t, *_ in rows], 1)
    op3.write_token_files(docs, str(tmp_path / "a"), P.path("word_bpe_49k.json"), 49408, 1, partitions=3, image_ids=500)
    got = _get(op3.read_token_files(spark, str(tmp_path / "a")))
    at = 0
    for i, w in enumerate(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(w), zlib.crc32(w)), i
        at += len(w)
    for name, df, n in (("b", odd, len(rows) + 4), ("c", empty, 0)):
        op3.write_token_files(df, str(tmp_path / name), P.path("word_bpe_49k.json"), 49408, 1, partitions=2)
        assert op3.read_token_files(spark, str(tmp_path / name)).count() == n


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31])
def test_packing_bits(width):
    v = np.random.default_rng(width).integers(0, 1 << width, 70_001)
    x = op3.Image(op3.write_image([5, None], np.array([3, len(v)]), v, width))
    assert x.doc_ids == [5, None] and (x.ids(0, len(v)) == v).all() and (x.ids(65_530, 65_560) == v[65_530:65_560]).all() and (x.document(0) == v[:3]).all() and len(x.ids(4, 4)) == 0


def test_chat_events(spark):
    e = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "delta", 2, "assistant", "he"), (1, 3, "delta", 2, "assistant", "llo"), (1, 4, "edit", 1, "user", "</s>[INST] \\ ok"),
        (1, 5, "message", 3, "user", "more"), (1, 6, "regenerate", 2, "assistant", "x"), (1, 7, "delta", 2, "assistant", "new"), (2, 1, None, 1, None, None), (None, None, "message", None, "tool", "t\nu"),
    ]
    m = op4.fold_events(spark.createDataFrame(e, "conv_id long, seq long, op string, msg long, role string, text string"))
    back = _get(op4.parse(op4.render(m)), "conv_id")
    assert [tuple(t) for t in back[1].turns] == [("user", "</s>[INST] \\ ok"), ("assistant", "new")] and back[1].loss_text == "new"
    assert [tuple(t) for t in back[2].turns] == [("", "")] and [tuple(t) for t in back[None].turns] == [("tool", "t\nu")]
    assert back[1].formatted.count("</s>") == 2
    assert op4.parse(op4.render(op4.fold_events(op4.events_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))).count() == 0


def _removed(text, counts, least):
    b = text.encode()
    gone = bytearray(len(b))
    for p in range(len(b) - least + 1):
        if counts[b[p : p + least]] > 1:
            gone[p : p + least] = b"\1" * least
    return b, gone


def test_suffix_array_dedup(docs, odd, empty, rows):
    least = 200
    counts = collections.Counter(b[p : p + least] for _, t, *_ in rows for b in [(t or "").encode()] for p in range(len(b) - least + 1))
    got = _get(op5.dedup_substrings(docs, digest=True))
    for i, t, *_ in rows:
        b, gone = _removed(t or "", counts, least)
        spans = sum(g and not gone[j - 1] if j else g for j, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i
    cut = op5.dedup_substrings(odd)
    assert cut.columns == [*odd.columns, "n_removed", "n_spans"] and cut.count() == len(rows) + 4
    assert op5.dedup_substrings(empty, digest=True).count() == 0


@pytest.mark.parametrize("hot", [64, 1 << 30])
def test_repeats_of_common_anchors(spark, hot):
    """A passage in thousands of contexts: windows dealt one by one give what shards give, and what brute force gives."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join([*(word() for _ in range(r.randint(2, 8))), *([passage[r.randint(0, 80) :]] if i % 8 else []), *(word() for _ in range(r.randint(2, 8)))]) for i in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    counts = collections.Counter(b[p : p + 200] for t in texts for b in [t.encode()] for p in range(len(b) - 199))
    got = _get(op5.dedup_substrings(docs, digest=True, hot=hot))
    for i, t in enumerate(texts):
        b, gone = _removed(t, counts, 200)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest()), i
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        gone = [0] * len(w)
        for p in range(len(w) - 19):
            if (k := tuple(w[p : p + 20])) in seen:
                gone[p : p + 20] = [1] * 20
            seen.add(k)
        want[i] = hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()
    assert {x.doc_id: x.kept_sha256 for x in op6.dedup_windows(docs, hot=hot).collect()} == want


def test_hot_anchors_are_found(spark):
    from tidemark.llm import _repeats

    texts = ["x" * 300 + f"{i:05d}" + "y" * 20 + f"{i * 7919 % 50000:05d}" + "z" * 300 for i in range(6000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    units = _repeats.Units("byte", 200, 32)
    some = _repeats.hot_anchors(docs, units, "text", sum(map(len, texts)), 512)
    assert 0 < len(some) < 100 and (np.diff(some.astype(object)) > 0).all()
    assert len(_repeats.hot_anchors(docs, units, "text", 1000, 512)) == 0


CLASHES = ["_ref", "_id", "_a", "_b", "_k1", "_k2", "_want", "_ranges", "n_spans", "n_removed", "_items", "_lcs", "_candidates", "row", "id", "ref", "component_id", "k", "n", "a.b", "_row"]


def test_clashing_columns(spark, rows):
    """Extra columns of any name are kept, on unique and on repeated ids."""
    base = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    for docs in (base, base.union(base.limit(3))):
        named = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES})
        for out, made in ((op5.dedup_substrings(named), {"n_removed", "n_spans"}), (op9.find_leaks(named, spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")), {"_items", "_lcs", "_candidates"}), (op10.filter_quality(named), set())):
            assert [c for c in out.columns if c not in made] == [c for c in named.columns if c not in made]
            got = out.select("doc_id", *(F.col(f"`{c}`") for c in CLASHES if c not in made)).collect()
            assert len(got) > 0 and all(x[1 + j] == f"{c}{x.doc_id}" for x in got for j, c in enumerate(c for c in CLASHES if c not in made))
        for out in (op6.dedup_windows(named), op7.jaccard_components(named), op8.pack(named, P.path("byte_bpe_50k.json"), 0), op2.scan_licenses(named), op10.score_quality(named)):
            assert out.count() > 0


def test_maximal_repeats():
    strings = [b"xxabcdefgh1", b"yyabcdefgh2", b"zzabcdeQ", b"abcdefg"]
    text, starts, ends = op5.joined(strings)
    raw = b"\0".join(strings) + b"\0"
    got = {(raw[at[0] : at[0] + n], tuple(sorted(at.tolist()))) for n, at in op5.maximal_repeats(text, starts, ends, 4)}
    place = lambda w: tuple(i for i in range(len(raw)) if raw.startswith(w, i))
    assert got == {(w, place(w)) for w in (b"abcdefgh", b"abcde", b"abcdefg")}


def test_substring_dedup(docs, odd, empty, rows):
    seen, want = set(), {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [0] * len(w)
        for p in range(len(w) - 19):
            if (k := tuple(w[p : p + 20])) in seen:
                gone[p : p + 20] = [1] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op6.dedup_windows(docs).collect()}
    assert got == want
    twice = [r for r in op6.dedup_windows(odd).collect() if r.doc_id == 3]
    assert len(twice) == 2 and len(set(twice)) == 1 and op6.dedup_windows(empty).count() == 0


def _sets(texts, n):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def _components(ids, sets, percent):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in zip(ids, sets):
        for b, y in zip(ids, sets):
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, rows, n, percent):
    r = random.Random(n)
    base = [f"w{r.randint(0, 50)}" for _ in range(120)]
    texts = [t for _, t, *_ in rows]
    for _ in range(40):  # a chain of near copies, some linked only through others
        base = list(base)
        for _ in range(r.randint(0, 3)):
            base[r.randrange(len(base))] = f"v{r.randint(0, 9)}"
        texts.append(" ".join(base))
    sets = _sets(texts, n)
    want = _components(range(len(texts)), sets, percent)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in op7.jaccard_components(df, n=n, percent=percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_jaccard_odd_rows(odd, empty):
    got = op7.jaccard_components(odd).collect()
    assert len(got) == odd.count() and all(r.component_id == 0 for r in got if r.doc_id is None and r.n_shingles)
    assert op7.jaccard_components(empty).count() == 0


def test_filters_never_lose_a_link():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(5, 80))
        x = np.unique(r.integers(0, 200, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[r.random(len(x)) < 0.93], r.integers(0, 200, 3).astype(np.uint64))))
        both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        assert op7.links(x, y, 85) == (100 * both >= 85 * union)
        bits = [op7._bitmaps(np.zeros(len(s), np.int64), s, 1) for s in (x, y)]
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(x) + len(y) - 2 * both


def _check_pieces(pieces, want, size=1024):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, ids in want.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length]) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    padding = 0
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
        padding += size - at
    return padding


def test_packing(docs, odd, empty, rows):
    want = dict(enumerate(_ids("byte_bpe_50k.json", [t or "" for _, t, *_ in rows], 0)))
    pieces = op8.pack(docs, P.path("byte_bpe_50k.json"), 0, open_windows=2).collect()
    assert _check_pieces(pieces, want) < 1024
    assert {p.doc_id for p in op8.pack(odd, P.path("byte_bpe_50k.json"), 0).collect()} == {*want, None}
    assert op8.pack(empty, P.path("byte_bpe_50k.json"), 0).count() == 0


def test_packer_bounded():
    p = op8.Packer(16, 3, 0)
    r = random.Random(1)
    for d in range(200):
        n = r.randint(1, 40)
        p.add(d, 0, np.arange(n, dtype=np.uint32), n)
        assert len(p.free) <= 3
    left = p.leftovers()
    assert sum(len(x[2]) for x in left) < 16


def test_decontamination(spark, empty):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 6))) for _ in range(3000)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [make(r.randint(15, 50)) for _ in range(30)]
    texts, leaks = [], {}
    for i in range(200):
        t = make(r.randint(5, 200))
        if i % 5 == 0:
            q = r.randrange(30)
            w = items[q].split()
            if i % 10 == 0:  # a paraphrase: words changed, the answer kept
                w = [x if k % 5 or k > len(w) - 8 else "other" for k, x in enumerate(w)]
            at = t.split()
            at[len(at) // 2 : len(at) // 2] = w
            t, leaks[i] = " ".join(at), q
        texts.append(t.upper() if i % 3 == 0 else t)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, None, None, None), (7, texts[7], "x", 0)], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, None), (98, "few words")], "item_id long, text string")
    got = {(x.doc_id, q) for x in op9.find_leaks(docs, bench).collect() for q in x._items}
    want = {(i, q) for i, q in leaks.items()}
    assert len(got & want) >= 0.9 * len(want) and got <= want
    assert op9.find_leaks(empty, bench).count() == 0
    assert all(not x._items for x in op9.find_leaks(docs.limit(5), bench.limit(0)).collect())


def _words_of(seed, n=3000):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(4, 7))) for _ in range(n)]
    return lambda k: [r.choice(vocabulary) for _ in range(k)]


def _found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(" ".join(t) for t in texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(items)], "item_id long, text string")
    return {(x.doc_id, q) for x in op9.find_leaks(docs, bench).collect() for q in x._items}


def test_decontamination_lengths(spark):
    """Items far longer than a passage, and items of a few words."""
    make = _words_of(11)
    items = [make(n) for n in (1200, 700, 260, 6, 3, 7)]
    long = [x if k % 3 or k > 254 else "other" for k, x in enumerate(items[2])]
    texts = [make(30) + items[0] + make(40), make(55) + items[1], make(35) + long + make(20), make(50) + items[3] + make(9), items[4], make(20) + items[5], make(300), items[3][:5] + make(40)]
    assert _found(spark, texts, items) == {(i, i) for i in range(6)}


def test_decontamination_many_items(spark):
    """Paraphrases of short items are found in a benchmark of more blocks than the basis has directions."""
    make = _words_of(12)
    items = [make(15) if i % 4 == 0 else make(118) for i in range(198)]
    texts = [make(70) + [x if k > 9 or k not in (0, 2, 4, 6, 8, 9) else "other" for k, x in enumerate(q)] + make(70) for q in items[::4]]
    assert _found(spark, texts, items) == {(i, 4 * i) for i in range(len(texts))}


def test_decontamination_changed_tails(spark):
    """Paraphrases keep 60 to 80% of the words, not the last ones; words of an item strewn over a text are no leak."""
    make, r = _words_of(13), random.Random(13)
    items = [make(r.randint(12, 59)) for _ in range(30)]
    texts = []
    for i, q in enumerate(items):
        n, w = len(q), list(q)
        lost = int(n * (0.22 + 0.18 * i / 30))
        for k in [n - 1, n - 3, *r.sample(sorted({*range(n)} - {n - 1, n - 3}), lost - 2)]:
            w[k] = "other"
        texts.append(make(60) + w + make(60))
    strewn = [y for k, x in enumerate(items[0]) for y in ([x, *make(3)] if k % 3 else make(4))]
    got = _found(spark, [*texts, make(20) + strewn], items)
    assert got <= {(i, i) for i in range(30)} and len(got) >= 28


def test_latent_basis_is_of_the_corpus(spark):
    """Words of one topic lie close in the basis, whatever the benchmark; a text that many rows share counts once."""
    r = random.Random(14)
    topics = [["".join(r.choice("klmnopqr") for _ in range(6)) for _ in range(40)] for _ in range(6)]
    texts = [" ".join(r.choice(t) for _ in range(48)) for t in topics for _ in range(60)]
    docs = spark.createDataFrame([(x,) for x in texts + texts[:1] * 300], "text string")
    make = _words_of(15)
    items = spark.createDataFrame([(" ".join(make(48)),) for _ in range(120)], "text string")
    idf = op9.passage_idf(docs)
    slot, _, wide, turn = op9.latent_basis(docs, items, idf, 300, rank=48)
    basis = wide.value @ turn
    words = [op9.Items.read(" ".join(t[a : a + 20]))[1] for t in topics for a in (0, 20)]
    v = [(idf[f] * basis[slot[f]].T).sum(1) for f in words]
    assert all(np.linalg.norm(x) > 0.3 * np.linalg.norm(idf[f]) for x, f in zip(v, words))
    v = [x / np.linalg.norm(x) for x in v]
    assert all(v[2 * i] @ v[2 * i + 1] > max(v[2 * i] @ v[2 * j + 1] for j in range(6) if j != i) for i in range(6))


def test_latent_basis_is_of_all_documents(spark):
    """Every word of two passages is in the basis, whatever the number of texts; it holds what numpy's SVD of all passages does, in one task or more."""
    r = random.Random(16)
    topics = [[f"t{i}w{k}" for k in range(12)] for i in range(20)]
    texts = [" ".join([f"n{i // 2}", *r.sample(topics[i % 20], 9)]) for i in range(4_200)]
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    items = spark.createDataFrame([("a b c d e f g h",)], "text string")
    idf = op9.passage_idf(docs)
    basis = []
    for given in (2_000, 100_000):
        slot, weight, wide, turn = op9.latent_basis(docs, items, idf, given, rank=24)
        basis.append(wide.value @ turn)
        assert all((slot[op9.Items.read(x)[1]] > 0).all() for x in texts)
    a = np.zeros((len(texts), len(weight)))
    for i, x in enumerate(texts):
        np.add.at(a[i], slot[op9.Items.read(x)[1]], 1)
    a *= weight
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    best = np.linalg.eigvalsh(a.T @ a)[::-1][:20].sum()
    for v in basis:
        assert np.abs(v.T @ v - np.eye(24)).max() < 0.01
        assert np.linalg.norm(a @ v) ** 2 > 0.97 * best
    assert np.linalg.norm(basis[0].T @ basis[1]) ** 2 > 23.9


def test_memo_goes_when_idle(monkeypatch):
    """A worker that goes on to other stages does not keep tokenizer and memo; a task that has them does."""
    import public_tokenizers

    from tidemark.llm import token_memo

    monkeypatch.setattr(token_memo, "IDLE", 0.2)
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_memo._OPEN.pop((path, True), None)
    memo = token_memo.hf_memo(path)
    buf = np.frombuffer(b"one two, one three", np.uint8)
    ids = memo.texts(buf, np.array([0, len(buf)]))[0].tolist()
    assert token_memo.hf_memo(path) is memo
    end = time.monotonic() + 10
    while (path, True) in token_memo._OPEN and time.monotonic() < end:
        time.sleep(0.05)
    assert (path, True) not in token_memo._OPEN
    assert memo.texts(buf, np.array([0, len(buf)]))[0].tolist() == ids == token_memo.hf_memo(path).texts(buf, np.array([0, len(buf)]))[0].tolist()


def test_fit_takes_every_block_in_small_parts():
    """The fit's parts hold each block of each text once, in bounded numbers, also of a text longer than a slice."""
    r = random.Random(17)
    texts = [" ".join(f"w{r.randrange(900)}" for _ in range(n)) for n in (0, 1, 24, 25, 70_000, 3, 400, 30_000)] + [None] + ["b c"] * 3_000
    slot = np.arange(op9.DIMS, dtype=np.int32)
    got = list(op9._blocks([pa.RecordBatch.from_arrays([pa.array(texts[i : i + 4], pa.string())], ["text"]) for i in range(0, len(texts), 4)], slot, 1 << 9))
    assert all(len(n) <= 1 << 9 and n.sum() == len(f) for f, n in got)
    want = [f[i : i + op9.BLOCK] for _, f in map(op9.Items.read, texts) for i in range(0, len(f), op9.BLOCK)]
    assert [x.tolist() for f, n in got for x in np.split(f, np.cumsum(n)[:-1])] == [x[x != 0].tolist() for x in want]


def test_subsequence_bound():
    """What is skipped before the subsequence is looked for could have had no larger share."""
    r = random.Random(18)
    for _ in range(300):
        pattern, text = ([r.randrange(12) for _ in range(r.randint(1, n))] for n in (20, 60))
        masks = {}
        for i, w in enumerate(pattern):
            masks[w] = masks.get(w, 0) | 1 << i
        most = op9.most_common(masks, text)
        assert op9.common_subsequence(masks, len(pattern), text) <= most <= min(len(pattern), len(text))
        assert op9.most_common(masks, [99, 98]) == 0 and op9.most_common(masks, pattern) == len(pattern)


def test_features_follow_the_vocabulary():
    """Few words of a large vocabulary share a feature, so rare words keep their weight."""
    _, f = op9.Items.read(" ".join(f"w{i}" for i in range(20_000)))
    assert len(np.unique(f)) > 0.95 * 20_000


def test_quality(docs, odd, empty, rows):
    got = _get(op10.score_quality(docs))
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
        hit = {q for p in range(len(w) - 7) if windows[tuple(w[p : p + 8])] > 1 for q in range(p, p + 8)}
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), base), i
        assert not (base and g.kept)
    assert got[0].kept and got[14].kept
    assert op10.filter_quality(odd).columns == odd.columns and op10.score_quality(odd).count() == odd.count()
    assert op10.filter_quality(empty).count() == op10.score_quality(empty).count() == 0


def _clean(text):
    """Brute force of operator 10's line rules: the text without failed lines, or None if it is rejected."""
    text, seen, kept, lost, left = text or "", set(), [], 0, 0
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
    hit = {q for p in range(len(w) - 7) if windows[tuple(w[p : p + 8])] > 1 for q in range(p, p + 8)}
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        body = line.rstrip("\n")
        words = WORD.findall(body)
        n, joined = len(words), "".join(words)
        if not words:
            kept.append(line)
            continue
        plain = re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", body)
        plain = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in plain]
        alpha = sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in joined)
        upper = sum("A" <= c <= "Z" for c in joined)
        symbols, shouts, bars = (len(re.findall(x, body)) for x in (r"[#*$%&|<>]", r"[!?]", "[|>»]"))
        phrase = lambda p: any(plain[i : i + len(p)] == p for i in range(len(plain)))
        bad = body in seen
        bad |= symbols * 5 > 2 * n and symbols > 1 or alpha * 2 < len(joined) or shouts * 2 > n and n > 3
        bad |= upper * 10 > 7 * max(alpha, 1) and n > 5
        bad |= bars > 1 and n <= 4 * (bars + 1) or sum(x in op10.NAVIGATION for x in plain) * 2 > n
        bad |= n <= 15 and any(phrase(p.split()) for p in op10.BOILERPLATE)
        bad |= sum(a == b for a, b in zip(words, words[1:])) * 2 > n
        bad |= n < 12 and words[-1][-1] not in ".!?:;,\"')]" + op10.CLOSING
        seen.add(body)
        if bad:
            lost += len(joined)
        else:
            left += n
            kept.append(line)
    base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return None if base or left < 20 or lost > 0.4 * max(sum(map(len, w)), 1) else "".join(kept)


def test_quality_by_line(spark):
    """Verdicts and cleaned texts of a whole table are those of the rules read line by line."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = [(-1, "a » b » c » d.\nsûr dû.\n" + "Only a plain sentence here, it says very little. " * 1), (-2, "\n\n" + "One two three four five six seven. " * 2 + "\n\nunended heading\n" + " ".join(f"w{i}" for i in range(30)) + "\n"), (-3, None)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    want = {r.doc_id: c for r in docs.collect() if (c := _clean(r.text)) is not None}
    got = {r.doc_id: r.text for r in op10.filter_quality(docs, clean=True).collect()}
    assert got == want
    assert {r.doc_id for r in op10.score_quality(docs).where("kept").collect()} == set(want)


def test_quality_lines(spark):
    good = "The quick brown fox jumps over the lazy dog and runs away from the hunters."
    bad = ["Home | About | Contact | Help", "WIN!! A!! PRIZE!! NOW!! CLICK!! HERE!!", "###$$$ %%%### &&&", good, "All rights reserved."]
    text = "\n".join([good, "Another sentence that stays in the document without any doubt at all, as it should.", *bad])
    row = op10.score_quality(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_text=True).first()
    assert row.n_bad_lines == 5 and row.clean_text.strip().count("\n") == 1 and not row.kept


def test_registry(spark):
    from tidemark.llm import registry

    names = [n for n in registry.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in registry.queries()
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert F is not None


def test_registered_token_queries(spark, sf):
    """op3 and op8 as registered, over a whole table, against the library's own tokenizers."""
    from tidemark.llm import registry

    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got, at = _get(registry.queries()["op3_token_ids"](spark, sf)), 0
    for (i, _), want in zip(rows, _ids("word_bpe_49k.json", [t for _, t in rows], 1)):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want), zlib.crc32(want)), i
        at += len(want)
    assert len(got) == len(rows)
    ids = dict(zip((i for i, _ in rows), _ids("byte_bpe_50k.json", [t for _, t in rows], 0)))
    pieces, filled = registry.queries()["op8_packing"](spark, sf).collect(), collections.defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and zlib.crc32(ids[p.doc_id][p.start : p.start + p.length]) == p.ids_crc32
        filled[p.sequence_id].append((p.offset, p.length))
    for i, want in ids.items():
        cut = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert [s for s, _ in cut] == [sum(n for _, n in cut[:k]) for k in range(len(cut))] and sum(n for _, n in cut) == len(want)
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024


def test_registered_substring_query(spark, sf):
    """op6 as registered against all windows of its table."""
    from tidemark.llm import registry

    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    seen, got = set(), _get(registry.queries()["op6_substring_dedup"](spark, sf))
    for i, text in rows:
        w = WORD.findall(text)
        gone = set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if window in seen else set()
            seen.add(window)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i
