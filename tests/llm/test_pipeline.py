"""The pipeline against a brute-force version of its stages on a small table."""

import collections
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, sf, tmp_path):
    from tests.llm.test_operators import _check_pieces, _clean, _components, _ids, _removed, _sets

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {"documents": docs}
    for name, f in corpus_pipeline.STAGES:
        before = docs
        out = f(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns
        held[name] = docs
    rows = {n: {r.doc_id: r.text for r in d.collect()} for n, d in held.items() if n != "packing"}
    first, kept = rows["documents"], rows["quality_rules"]
    assert kept == {i: c for i, t in first.items() if (c := _clean(t)) is not None}
    assert all(r.n_chars == len(r.text) for r in held["quality_rules"].collect())
    ids = sorted(kept)
    groups = _components(ids, _sets([kept[i] for i in ids], 5), 80)
    one = rows["ngram_jaccard_join"]
    assert set(one) == {i for i in ids if groups[i] == i}
    seen = {}
    for i, t in one.items():
        b = t.encode()
        for p in range(len(b) - 199):
            seen[b[p : p + 200]] = seen.get(b[p : p + 200], 0) + 1
    cut, want = rows["suffix_array_dedup"], {}
    for i, t in one.items():
        b, gone = _removed(t, collections.Counter(seen), 200)
        at, text = 0, ""
        for c in t:  # a character goes if all its bytes do
            size = len(c.encode())
            text += "" if all(gone[at : at + size]) else c
            at += size
        if text.strip(" "):
            want[i] = text
    assert cut == want
    norm = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) + " "
    bench = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = rows["benchmark_decontamination"]
    leaks = {i for i, t in cut.items() if any(q in norm(t) for q in bench)}
    assert set(clean) == set(cut) - leaks
    order = sorted(clean)
    want = dict(zip(order, _ids("byte_bpe_50k.json", [clean[i] for i in order], 0)))
    assert _check_pieces(held["packing"].collect(), want) < 1024


def test_near_duplicates_by_id_and_text(spark, sf):
    """Different texts that share an id, or have none, all stay; their copies go."""
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcde")
    rows = [(1, a), (5, b), (5, c), (None, d), (None, e), (7, c), (5, a), (None, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((x.doc_id or 0, x.text) for x in got.collect()) == sorted([(1, a), (5, b), (5, c), (0, d), (0, e)])


def test_leak_stage_fits_all_documents(spark, tmp_path, monkeypatch):
    """The leak stage's basis has every word that two texts share, however many texts there are."""
    from tidemark.llm import op9_benchmark_decontamination as op9

    texts = [f"pair{i // 2} " + " ".join(f"t{i % 20}w{k}" for k in range(9)) for i in range(4_200)]
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, fit = [], op9.latent_basis
    monkeypatch.setattr(op9, "latent_basis", lambda *a, **b: made.append(fit(*a, **b)) or made[-1])
    assert corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).count() == len(texts)
    assert all((made[0][0][op9.Items.read(x)[1]] > 0).all() for x in texts)
