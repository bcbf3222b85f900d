"""Operator 12, phrase collocation mining: pivot partitioning.

1. Slices of texts are cut into pieces and words and written once: each word as
   its place in the slice's own dictionary, which holds the slice's distinct
   words and their counts.
2. The dictionaries are summed to exact word frequencies; words of ``least``
   occurrences or more are numbered by falling frequency, so a larger number is
   a rarer word.  Each slice gets the numbers of its own words by a join: no
   task holds the vocabulary.
3. Each place of a slice is a pivot: its fragment is the word and up to three
   words on either side, cut where a piece ends, a word is infrequent or a word
   is rarer than the pivot (on the left: or the pivot itself, so that an n-gram
   belongs to the first place of its rarest word).  Equal fragments of a slice
   are counted, and fragments go to the part of their pivot.
4. A part counts the n-grams that hold their pivot, shorter ones first: a longer
   one is looked at only where its own n-grams with the pivot are frequent.
   Every n-gram has one pivot, so counts are final; only pivots of more than
   ``SPLIT`` occurrences are dealt over several parts, whose sums meet once more.
5. Candidates get the frequencies of their parts by joins, scores as exact
   decimals, and the best ``top`` of each language.

A task holds one slice (``SLICE_BYTES`` of text, or one longer text, cut in blocks
of words) or one part (``PART`` fragments); the driver holds a few counts.

Null texts are empty; a null language is ``und``.  Ids do not matter, so null ids
are like others and a repeated row counts as often as it is there.  Ties in score
go by a, then by the phrase's bytes; of equal cuts the first counts.  An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._io import materialize, quoted, scratch, skew_join
from ._vec import BYTE_LOWER, U, lut, mix, same_spans, span_hash, spans, text_slices

SLICE_BYTES, PART, SPLIT = 16 << 20, 1 << 20, 1 << 20
#: Words looked at at a time, and fragments of a slice that are counted together.
BLOCK, TOGETHER = 1 << 18, 1 << 21
#: Bytes of a long text that are cut into words at a time.
STEP = 4 << 20
SEPARATOR = lut(b".,;:!?\n\x0b\x0c\r")
WORD = ~(SEPARATOR | lut(b" \t"))
#: Words on either side of a pivot that an n-gram may take, shorter n-grams first, and the n-grams in it that must be frequent.
WINDOWS = {(0, 1): (), (1, 0): (), (0, 2): ((0, 1),), (1, 1): ((1, 0), (0, 1)), (2, 0): ((1, 0),), (0, 3): ((0, 2),), (1, 2): ((1, 1), (0, 2)), (2, 1): ((2, 0), (1, 1)), (3, 0): ((2, 0),)}


def pieces(buf: np.ndarray, off: np.ndarray, step: int = STEP):
    """Of some rows' folded bytes: starts and ends of words, and whether a piece begins at each."""
    if len(off) > 2 or len(buf) <= step:
        s, e, row = spans(buf, off, WORD)
        seps = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(SEPARATOR[buf], out=seps[1:])
        new = np.ones(len(s), bool)
        new[1:] = seps[s[1:]] > seps[e[:-1]]
        new[row[:-1][row[:-1] < len(s)]] = True
        return s, e, new
    found, at, cut = [], 0, True  # one long text, in steps that end between words
    while at < len(buf):
        end = min(at + step, len(buf))
        while end < len(buf) and WORD[buf[end]]:
            stop = np.flatnonzero(~WORD[buf[end : end + 4096]])
            end = end + int(stop[0]) if len(stop) else min(end + 4096, len(buf))
        part = buf[at:end]
        s, e, new = pieces(part, np.array([0, len(part)]), len(part))
        if len(s):
            new[0] = cut or SEPARATOR[part[: s[0]]].any()
            found.append((s + at, e + at, new))
        cut = (cut and not len(s)) or SEPARATOR[part[e[-1] if len(s) else 0 :]].any()
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def dictionary(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each word's place among the distinct words, these, and their counts.  Words are told apart by their bytes."""
    u, first, place, count = np.unique(span_hash(buf, s, e), return_index=True, return_inverse=True, return_counts=True)
    for i in range(0, len(s), BLOCK):
        a, b, w = s[i : i + BLOCK], e[i : i + BLOCK], first[place[i : i + BLOCK]]
        if not ((b - a == e[w] - s[w]).all() and same_spans(buf, a, b, buf, s[w])):  # words that share a hash
            raw = buf.tobytes()
            by: dict[bytes, int] = {}
            place = np.array([by.setdefault(raw[x:y], len(by)) for x, y in zip(s.tolist(), e.tolist())])
            return place, pa.array([x.decode() for x in by], pa.string()), np.bincount(place)
    size = e[first] - s[first]
    ends = np.concatenate(([0], np.cumsum(size)))
    inside = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    data = buf[np.repeat(s[first], size) + inside]
    return place, pa.StringArray.from_buffers(len(u), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())), count


SLICES = "slice long, lang string, n long, ids binary, new binary, words array<string>, counts array<long>"


def _slices(limit: int):
    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {}
        size = 0

        def flush(lang: str, parts: list) -> pa.RecordBatch:
            at = np.cumsum([0, *(len(x[0]) for x in parts)])
            buf = np.concatenate([x[0] for x in parts])
            s, e = (np.concatenate([x[k] + o for x, o in zip(parts, at)]) for k in (1, 2))
            place, words, count = dictionary(buf, s, e)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(count, pa.int64()))]
            new = np.packbits(np.concatenate([x[3] for x in parts]))
            one = [pa.array([task << 32 | made], pa.int64()), pa.array([lang]), pa.array([len(s)], pa.int64()), pa.array([place.astype("<u4").tobytes()], pa.binary()), pa.array([new.tobytes()], pa.binary()), *lists]
            return pa.RecordBatch.from_arrays(one, [x.split()[0] for x in SLICES.split(", ")])

        for batch in batches:
            lang = pc.fill_null(batch.column(0), "und")
            for name in pc.unique(lang).to_pylist():
                text = batch.column(1).filter(pc.equal(lang, name))
                for _, _, buf, off in text_slices(text):
                    buf = BYTE_LOWER[buf]
                    s, e, new = pieces(buf, off)
                    if len(s):
                        held.setdefault(name, []).append((buf, s, e, new))
                        size += len(buf)
                    if size >= limit:
                        for k, parts in held.items():
                            yield flush(k, parts)
                            made += 1
                        held, size = {}, 0
        for k, parts in held.items():
            yield flush(k, parts)
            made += 1

    return run


def packed_keys(columns: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Columns of numbers up to ``most`` as few 64-bit keys, the first column in the highest bits of the last key."""
    bits = max(1, int(most).bit_length())
    each, keys = max(1, 64 // bits), []
    for i in range(0, len(columns), each):
        key = columns[i].astype(U)
        for c in columns[i + 1 : i + each]:
            key = key << U(bits) | c.astype(U)
        keys.append(key)
    return keys[::-1]


def grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, and the first of each group in it."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    if not len(order):
        return order, order
    differ = np.zeros(len(order) - 1, bool)
    for key in keys:
        k = key[order]
        differ |= k[1:] != k[:-1]
    return order, np.flatnonzero(np.concatenate(([True], differ)))


def fragments(rank: np.ndarray, new: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """Fragments of the pivots at places lo to hi: columns left 3, 2, 1, pivot, right 1, 2, 3; 0 where there is none.

    ``rank``: 0 for an infrequent word, else larger for a rarer one.
    """
    n = len(rank)
    mid = rank[lo:hi]
    at = np.arange(lo, hi)
    columns = {0: mid}
    for side in (-1, 1):
        ok = mid > 0
        for d in (1, 2, 3):
            there = at + side * d
            inside = (there >= 0) & (there < n)
            safe = np.where(inside, there, 0)
            other = rank[safe]
            edge = new[np.where(inside, there + 1, 0) if side < 0 else safe]
            ok = ok & inside & ~edge & (other > 0) & ((other < mid) if side < 0 else (other <= mid))
            columns[side * d] = np.where(ok, other, 0).astype(rank.dtype)
    some = np.flatnonzero((columns[-1] > 0) | (columns[1] > 0))
    return [columns[k][some] for k in range(-3, 4)]


def _route(parts: int, split: int, kind: str):
    """Fragments of a slice, counted and packed by the part of their pivots."""
    schema = pa.schema([("part", pa.int64()), ("hot", pa.bool_()), ("n", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])

    def run(payload: pa.Table, known: pa.Table) -> pa.Table:
        codec, rows = pa.Codec("zstd"), [[], [], [], [], []]

        def flush(columns: list[np.ndarray]) -> None:
            # pivot first, so that equal pivots stand together
            order, first = grouped(packed_keys([columns[i] for i in (3, 2, 4, 1, 5, 0, 6)], len(ids)))
            if not len(order):
                return
            count = np.diff(np.append(first, len(order)))
            columns = [c[order[first]] for c in columns]
            pivot, salt = columns[3], np.zeros(len(first), U)
            many = np.flatnonzero(salts[pivot] > 1)
            if len(many):
                own = np.zeros(len(many), U)
                for c in columns:
                    own = mix(own ^ ids[c[many]].astype(U))
                salt[many] = own % salts[pivot[many]].astype(U)
            part = (mix(mix(ids[pivot].astype(U)) + salt) % U(parts)).astype(np.int64)
            hot = salts[pivot] > 1
            order, first = grouped([hot.astype(U), part.astype(U)])
            for a, b in zip(first.tolist(), np.append(first[1:], len(order)).tolist()):
                x = order[a:b]
                data = b"".join([*(ids[c[x]].astype(kind).tobytes() for c in columns), count[x].astype("<u4").tobytes()])
                for held, value in zip(rows, (part[x[0]], hot[x[0]], len(x), len(data), codec.compress(data, asbytes=True))):
                    held.append(value)

        if payload.num_rows and known.num_rows:
            places = np.frombuffer(payload["ids"][0].as_buffer(), "<u4")
            new = np.unpackbits(np.frombuffer(payload["new"][0].as_buffer(), np.uint8), count=len(places)).astype(bool)
            known = known.sort_by("id")
            ids = np.concatenate(([0], known["id"].to_numpy()))
            salts = np.concatenate(([1], -(-known["f"].to_numpy() // split)))
            ranks = np.zeros(int(places.max()) + 1, np.int32)
            ranks[known["pos"].to_numpy()] = np.arange(1, len(ids))
            rank, held, size = ranks[places], [], 0
            for lo in range(0, len(rank), BLOCK):
                held.append(fragments(rank, new, lo, min(lo + BLOCK, len(rank))))
                size += len(held[-1][0])
                if size >= TOGETHER or lo + BLOCK >= len(rank):
                    flush([np.concatenate(x) for x in zip(*held)])
                    held, size = [], 0
        return pa.table([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

    return run, "part long, hot boolean, n long, size long, data binary"


def mine(columns: list[np.ndarray], count: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, their counts) that hold their fragments' pivot and occur ``least`` times or more."""
    u, local = np.unique(np.concatenate(columns), return_inverse=True)
    local = local.reshape(len(columns), -1)
    frequent: dict[tuple[int, int], np.ndarray] = {}
    out = []
    for (left, right), inner in WINDOWS.items():
        ok = (columns[3 - left] > 0) & (columns[3 + right] > 0)
        for x in inner:
            ok &= frequent[x]
        at = np.flatnonzero(ok)
        span = range(3 - left, 4 + right)
        order, first = grouped(packed_keys([local[i][at] for i in span], len(u)))
        total = np.add.reduceat(count[at[order]], first) if len(first) else np.zeros(0, np.int64)
        good = total >= least
        frequent[left, right] = np.zeros(len(count), bool)
        frequent[left, right][at[order]] = np.repeat(good, np.diff(np.append(first, len(order))))
        pick = at[order[first[good]]]
        out.append((np.column_stack([columns[i][pick] for i in span]).astype(np.int64).reshape(len(pick), len(span)), total[good]))
    return out


def _mined(least: int, kind: str):
    def run(t: pa.Table) -> pa.Table:
        codec, grams, totals = pa.Codec("zstd"), [], []
        width = np.dtype(kind).itemsize
        for hot in (False, True):
            rows = t.filter(pc.equal(t["hot"], hot))
            if not rows.num_rows:
                continue
            held: list[list] = [[] for _ in range(8)]
            for n, size, data in zip(rows["n"].to_pylist(), rows["size"].to_pylist(), rows["data"]):
                raw = np.frombuffer(codec.decompress(data.as_buffer(), size), np.uint8)
                for k in range(8):
                    held[k].append(raw[k * n * width : (k + 1) * n * width].view(kind) if k < 7 else raw[7 * n * width :].view("<u4"))
            # a hot pivot's counts are sums of one part of its fragments: all of them go on
            columns = [np.concatenate(x) for x in held]
            for g, c in mine(columns[:7], columns[7].astype(np.int64), 1 if hot else least):
                grams.append(pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1) * g.shape[1], pa.int32()), pa.array(g.ravel(), pa.int64())))
                totals.append(pa.array(c, pa.int64()))
        return pa.table({"gram": pa.chunked_array(grams, pa.list_(pa.int64())), "a": pa.chunked_array(totals, pa.int64())})

    return run, "gram array<long>, a long"


def vocabulary(words: DataFrame, least: int) -> DataFrame:
    """lang, word, f, id of the words that occur ``least`` times or more; ids from 1 by falling frequency."""
    counted = words.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    placed = materialize(counted.orderBy(F.desc("f"), "lang", "word").withColumn("_place", F.monotonically_increasing_id()), "vocabulary")
    sizes = {r[0]: r[1] for r in placed.groupBy(F.shiftright("_place", 33)).count().collect()}  # one row a partition
    before = np.concatenate(([0], np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]))).tolist()
    base = F.element_at(F.array(*(F.lit(x).cast("long") for x in before)), (F.shiftright("_place", 33) + 1).cast("int"))
    return placed.select("lang", "word", "f", (base + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("id"))


def candidates(docs: DataFrame, lang_col: str, text_col: str, least: int, slice_bytes: int = SLICE_BYTES, part: int = PART, split: int = SPLIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 2 to 4 words (gram: word ids) and their frequencies a, the vocabulary, and the words of each language."""
    picked = docs.select(F.col(quoted(lang_col)).cast("string"), F.col(quoted(text_col)))
    slices = materialize(picked.mapInArrow(_slices(slice_bytes), SLICES), "slices")
    zipped = slices.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x"))
    words = zipped.select("slice", "lang", "pos", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    vocab = vocabulary(words, least)
    size, total = vocab.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    kind = "<u4" if size < 1 << 32 else "<u8"
    known = words.join(vocab, ["lang", "word"]).select(F.col("slice").alias("of"), "pos", "id", "f")
    run, schema = _route(max(1, math.ceil(total / part)), split, kind)
    routed = slices.select("slice", "ids", "new").groupBy("slice").cogroup(known.groupBy("of")).applyInArrow(run, schema)
    run, schema = _mined(least, kind)
    mined = routed.groupBy("part").applyInArrow(run, schema)
    found = materialize(mined.groupBy("gram").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "candidates")
    return found, vocab, slices.groupBy("lang").agg(F.sum("n").alias("n"))


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def scored(found: DataFrame, vocab: DataFrame, cover: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers."""
    each = found.select("gram", F.posexplode("gram").alias("pos", "id"))
    named = skew_join(each, vocab.select("id", "lang", "word", "f"), ["id"]).groupBy("gram").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("pos", "word", "f"))).alias("w"))
    places = F.when(F.size("gram") == 3, F.expr("array(struct(0 s, 2 n), struct(1 s, 2 n))")).otherwise(F.expr("array(struct(0 s, 2 n), struct(1 s, 2 n), struct(2 s, 2 n), struct(0 s, 3 n), struct(1 s, 3 n))"))
    inner = found.where(F.size("gram") > 2).select("gram", "a", F.explode(places).alias("p")).select("gram", "a", "p", F.slice("gram", F.col("p.s") + 1, F.col("p.n")).alias("part"))
    asked = inner.join(found.select(F.col("gram").alias("part"), F.col("a").alias("f")), "part")
    at = lambda s, n: F.max(F.when((F.col("p.s") == s) & (F.col("p.n") == n), F.col("f"))).alias(f"f{s}{n}")
    inside = asked.groupBy("gram").agg(*(at(s, n) for s, n in ((0, 2), (1, 2), (2, 2), (0, 3), (1, 3))))
    longer = inner.groupBy(F.col("part").alias("gram")).agg(F.max("a").alias("longer"))
    all_ = found.join(named, "gram").join(inside, "gram", "left").join(longer, "gram", "left")
    kept = all_.where(F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * cover))

    def cut(k: int, left: Column, right: Column) -> Column:
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * _exact(F.col("a")), _exact(left) + _exact(right))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    one = lambda i: F.col("w")[i]["f"]
    f = F.col
    cuts = (
        F.when(F.size("gram") == 2, F.array(cut(1, one(0), one(1))))
        .when(F.size("gram") == 3, F.array(cut(1, one(0), f("f12")), cut(2, f("f02"), one(2))))
        .otherwise(F.array(cut(1, one(0), f("f13")), cut(2, f("f02"), f("f22")), cut(3, f("f03"), one(3))))
    )
    best = kept.select("lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"), "a", F.array_min(cuts).alias("c"))
    return best.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, cover: int = 80, top: int = 2000, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    spark = docs.sparkSession
    with scratch(spark) as outer:
        found, vocab, n = candidates(docs, lang_col, text_col, least, **sizes)
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = scored(found, vocab, cover).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        return materialize(ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", outer)


def query(spark, sf_dir):
    """The first 2000 phrases of every language of ``documents``."""
    from ._io import table

    return collocations(table(spark, sf_dir, "documents", "lang", "text"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
grams AS (SELECT lang, w[i:i + k - 1] AS g FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
parts AS (
  SELECT c.*, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:len(c.g)]),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
subs AS (
  SELECT lang, a, g[s:s + n - 1] AS g FROM (SELECT lang, a, g, unnest(range(1, len(g))) AS s FROM f WHERE len(g) > 2), (SELECT unnest([2, 3]) AS n)
  WHERE n < len(g) AND s + n - 1 <= len(g)),
longer AS (SELECT lang, g, max(a) AS b FROM subs GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer x ON x.lang = b.lang AND x.g = b.g WHERE x.b IS NULL OR 100 * x.b < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank FROM kept)
JOIN words USING (lang) WHERE rank <= 2000
"""
