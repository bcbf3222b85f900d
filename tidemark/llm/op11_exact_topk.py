"""Operator 11, exact top-k search: exhaustive term-at-a-time accumulation.

Vectors are quantized to integers, floor(scale * x).  Queries and candidates are
dealt into blocks by the hash of id and content, and every query block meets
every candidate block in a cell, which is one group of a cogrouped exchange.
In a cell the candidates become postings (term, weights); each term of a query,
where its weight is not zero, scatters its weighted postings into the query's
dense array of scores.  A partition selection keeps k of each query, and the
cells' lists merge in a ranking per query.  Nothing is approximate or left out:
the work is queries times candidates, the exchange carries each candidate once a
query block and each query once a candidate block, and a cell's memory is set by
``QUERY_VALUES`` and ``CANDIDATE_VALUES``, not by the tables.

Scores are exact: 32- or 64-bit floats while no partial sum can reach 2**24 or
2**53, else Python integers; a score beyond 64 bits counts as the nearest long.
Ties go to the smaller id.  A vector that is null or holds a null or a
component that is not finite (or not, times scale) takes no part, nor does a row
without an id.  Missing components of a shorter vector are zeros; an empty vector
scores zero.  A candidate with a query's own id is not its candidate.  Rows
repeated in id and vector count as often as they are there among candidates (k of
them suffice, so they are counted before the exchange and a very common row is one)
and are one query; rows of one id with different vectors are queries of their own.
Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._io import quoted

#: Vector components of a query block and of a candidate block (four bytes each in the exchange).
QUERY_VALUES, CANDIDATE_VALUES = 1 << 22, 1 << 19
#: Scores that are accumulated at a time.
SCORES = 1 << 19
_LONG = (1 << 63) - 1


def matrix(vectors: pa.ChunkedArray, scale: int, terms: int) -> np.ndarray:
    """Quantized components, one row per vector, zeros where a vector is shorter."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), terms))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def exact_kind(queries: np.ndarray, candidates: np.ndarray):
    """The narrowest type in which every partial sum of every score is exact."""
    most = sum(int(a) * int(b) for a, b in zip(np.abs(queries).max(0, initial=0), np.abs(candidates).max(0, initial=0)))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def postings(candidates: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Of each term the candidates that have it (None: taken as all) and their weights."""
    out = []
    for column in candidates.T:
        at = np.flatnonzero(column != 0)
        out.append((None, np.ascontiguousarray(column)) if 2 * len(at) > len(column) else (at, column[at]))
    return out


def accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], n: int) -> np.ndarray:
    """Scores of some queries against all n candidates, a term at a time."""
    scores, room = (np.zeros((len(queries), n), queries.dtype) for _ in range(2))
    for t, (at, weights) in enumerate(lists):
        rows = np.flatnonzero(queries[:, t] != 0)
        if not len(rows) or not len(weights):
            continue
        if at is None and len(rows) == len(queries):
            scores += np.multiply(queries[:, t, None], weights, out=room)
        elif at is None:
            scores[rows] += queries[rows, t, None] * weights
        else:
            scores[np.ix_(rows, at)] += queries[rows, t, None] * weights
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of a row, the first of equal ones, in any order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero((scores > least).astype(bool))
        return np.concatenate((above, np.flatnonzero((scores == least).astype(bool))[: k - len(above)]))
    return np.arange(len(scores))


def _cell(k: int, scale: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        schema = pa.schema([("query_id", pa.int64()), ("ref", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if queries.num_rows and candidates.num_rows:
            candidates = candidates.sort_by("id")
            ids = np.repeat(candidates["id"].to_numpy(), candidates["copies"].to_numpy())
            terms = max(x["vec"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max() for x in (queries, candidates))
            q, c = matrix(queries["vec"], scale, int(terms)), matrix(candidates["vec"], scale, int(terms))
            kind = exact_kind(q, c)
            q, c = (np.vectorize(int, otypes=[object])(x) if kind is object and x.size else x.astype(kind) for x in (q, c))
            c = np.repeat(c, candidates["copies"].to_numpy(), axis=0)
            lists, own = postings(c), queries["id"].to_numpy()
            first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
            ref, step = queries["ref"].to_numpy(), max(1, SCORES // len(ids))
            for i in range(0, len(q), step):
                sums = accumulate(q[i : i + step], lists, len(ids))
                for j, scores in enumerate(np.minimum(np.maximum(sums, -_LONG - 1), _LONG) if kind is object else sums, i):
                    scores[first[j] : last[j]] = -math.inf
                    at = best(scores, k)
                    at = at[(scores[at] != -math.inf).astype(bool)]
                    out[0].append(np.full(len(at), own[j]))
                    out[1].append(np.full(len(at), ref[j]))
                    out[2].append(ids[at])
                    out[3].append(scores[at].astype(np.int64))
        return pa.table([np.concatenate(x) if x else np.zeros(0, np.int64) for x in out], schema=schema)

    return run


def _valid(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    finite = lambda x: F.coalesce(F.abs(x.cast("double") * scale) < F.lit(math.inf), F.lit(False))
    picked = rows.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vec_col)).alias("vec"))
    return picked.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", finite))


def _blocks(n: int, terms: int, values: int) -> int:
    return max(1, math.ceil(n * max(terms, 1) / values))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, ref (hash of the query's vector), rank from 1, vec_id, score: the k highest inner products of each query."""
    asked, held = _valid(queries, id_col, vec_col, scale), _valid(candidates, id_col, vec_col, scale)
    measure = lambda rows: rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    (n, width), (m, wide) = measure(asked), measure(held)
    left, right = _blocks(n, max(width, wide), QUERY_VALUES), _blocks(m, max(width, wide), CANDIDATE_VALUES)
    deal = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "id", "vec"), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = asked.distinct().select("id", "vec", F.xxhash64("vec").alias("ref"), deal(1, left).alias("l"), every(right).alias("r"))
    held = held.groupBy("id", "vec").agg(F.least(F.count("*"), F.lit(k)).alias("copies")).select("id", "vec", "copies", every(left).alias("l"), deal(2, right).alias("r"))
    parts = min(10_000, 4 * left * right)
    cells = [x.withColumn("cell", F.col("l") * right + F.col("r")).drop("l", "r").repartition(parts, "cell").groupBy("cell") for x in (asked, held)]
    found = cells[0].cogroup(cells[1]).applyInArrow(_cell(k, scale), "query_id long, ref long, vec_id long, score long")
    order = Window.partitionBy("query_id", "ref").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "ref", "rank", "vec_id", "score")


def query(spark, sf_dir):
    """The 5 best of every vector whose id is divisible by 50, against all ``embeddings``."""
    from ._io import table

    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows).drop("ref")


ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
terms AS (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS t FROM whole),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM terms q JOIN terms c ON q.t = c.t AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
