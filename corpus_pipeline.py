"""The corpus pipeline: quality rules, near-duplicate join, repeated substrings, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  All but the last keep
the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm._io import free_shuffles, materialize, packed_rows, scratch, table, unpacked_rows, with_ref
from tidemark.llm.op5_suffix_array_dedup import dedup_substrings
from tidemark.llm.op7_ngram_jaccard_join import jaccard_components
from tidemark.llm.op8_packing import pack
from tidemark.llm.op9_benchmark_decontamination import find_leaks
from tidemark.llm.op10_quality_rules import filter_quality


def stage(f):
    """Free the shuffle files of the stages before: their results are written, but a driver that makes little garbage keeps them."""

    @functools.wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free_shuffles(spark)
        return f(spark, docs, sf_dir)

    return call


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars``, where it is a column, follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else docs


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first cleaning: failed lines go, then documents that lost too much; null and empty texts go too.

    Ids do not matter, so rows that share one or have none, and repeated rows, are judged each for itself.
    """
    return _sized(filter_quality(docs, clean=True), docs.columns).select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word shingles of five at 0.8 or more: the one of the smallest id.

    Rows are told apart by id and text, so rows that share an id or have none are kept unless their texts are near copies.
    Null and empty texts link with nothing and stay; of rows repeated in id and text one stays.
    """
    named = with_ref(packed_rows(docs, "doc_id", "text"), "id", "text")
    group = jaccard_components(named.select("_ref", "text"), "_ref", n=5, percent=80).select("_ref", "component_id").distinct()
    kept = materialize(group.where("_ref = component_id").select("_ref"), "kept")
    one = named.join(kept, "_ref", "left_semi")
    refs = named.agg(F.count("*"), F.count_distinct("_ref")).first()
    return unpacked_rows(one if refs[0] == refs[1] else one.dropDuplicates(["_ref"]), docs.columns, "text", [])


@stage
def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that stand elsewhere; n_chars follows, emptied documents go.

    A null text stays null; rows that are repeated or share an id are documents of their own, so they lose what they share.
    """
    cut = _sized(dedup_substrings(docs).drop("n_removed", "n_spans"), docs.columns)
    return cut.where("text is null or trim(text) <> ''").select(*docs.columns)


@stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, an empty benchmark takes nothing."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("_items") == 0).select(*docs.columns)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; a null text is one end token."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_substrings),
    ("benchmark_decontamination", benchmark_leaks),
    ("packing", packed),
]

#: SQL cannot express the suffix-array, latent retrieval and packing stages; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; only the last one's table is left in the scratch folder."""
    with scratch(spark) as outer:
        docs = table(spark, sf_dir, "documents")
        for name, step in STAGES[:-1]:
            docs = materialize(step(spark, docs, sf_dir), name)
        return materialize(STAGES[-1][1](spark, docs, sf_dir), "packed", outer)
