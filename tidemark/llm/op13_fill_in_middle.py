"""Operator 13, fill-in-middle transformation: escaped marker injection, DataFrame functions only.

A text is cut into units (white space with the word after it, or white space at
the end).  A delimiter is escaped in the text, ``regexp_replace`` puts it after
every unit, the delimiters are counted, ``substring_index`` takes the units up
to a rank from the left or from the right, and the parts lose delimiters and
escapes again.  Two ranks, the form and the order come from the hash of seed and
id, so a row's result depends on nothing but the row: no shuffle, no state.

Forms: ``plain`` is the text itself; ``psm`` is prefix, suffix, middle and
``spm`` suffix, prefix, middle, each after its marker.  Texts that are empty or
hold a marker stay plain, so :func:`restore` is exact.

A null text is empty (plain, no units).  A null id is hashed as an empty one.
Repeated rows give repeated results; there are no ties.  Texts of any length are
cut whole; a text is held a few times in memory.  An empty table gives an empty
result.  Extra columns of any name are kept by :func:`fill_in_middle`; those
named as the columns it makes are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._io import quoted

#: The markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Delimiter and escape character; an escaped text holds no delimiter.
DELIMITER, ESCAPE = "\x01", "\x02"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MADE = ("n_units", "form", "prefix", "middle", "suffix", "output")


def escape(c: Column) -> Column:
    """Delimiters and escapes as an escape and a letter; neither is white space, so units stay as they are."""
    return F.replace(F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _check(markers: tuple[str, str, str]) -> None:
    """A text without markers must not form one where it meets a marker."""
    for a in markers:
        for b in markers:
            inside = a != b and a in b
            meets = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b)))
            if not a or inside or meets or len(set(markers)) < 3:
                raise ValueError("markers must be three, not empty, and none may hold, or end as, the beginning of another")


def _at_rank(marked: str, rank: Column) -> Column:
    """``substring_index`` by a computed rank."""
    return F.call_function("substring_index", F.col(marked), F.lit(DELIMITER), rank.cast("int"))


def _part(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(DELIMITER), F.lit("")))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``docs`` with n_units, form, prefix, middle, suffix (null if plain) and output.

    ``rate`` of 100 texts are cut, ``spm`` of 100 of those take the suffix first.
    """
    _check(markers)
    p, s, m = (F.lit(x) for x in markers)
    rest = [F.col(quoted(c)) for c in docs.columns]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(quoted(id_col)).cast("string").alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("t"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")
    marked = F.regexp_replace(escape(F.col("t")), UNIT, "$0" + DELIMITER)
    rows = rows.select("row", "t", digest.alias("digest"), marked.alias("marked"))
    rows = rows.withColumn("n", (F.octet_length("marked") - F.octet_length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    cuts = [draw(0) % (F.col("n") + 1), draw(1) % (F.col("n") + 1)]
    plain = (F.col("t") == "") | F.contains("t", p) | F.contains("t", s) | F.contains("t", m) | (draw(2) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(3) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("row", "t", "n", F.when(~plain, F.col("marked")).alias("marked"), F.least(*cuts).alias("lo"), F.greatest(*cuts).alias("hi"), form.alias("form"))
    rows = rows.withColumn("head", _at_rank("marked", F.col("hi")))
    parts = rows.select(
        "row", "t", "n", "form",
        _part(_at_rank("marked", F.col("lo"))).alias("prefix"),
        _part(_at_rank("head", F.col("lo") - F.col("hi"))).alias("middle"),
        _part(_at_rank("marked", F.col("hi") - F.col("n") - 1)).alias("suffix"),
    )
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("t"))
    made = {"n_units": F.col("n"), "output": output}
    return parts.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in MADE), *(made.get(c, F.col(c)).alias(c) for c in MADE))


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text, from output and form alone."""
    p, s, m = markers
    left = lambda c, x: F.substring_index(c, x, 1)
    right = lambda c, x: F.substring_index(c, x, -1)
    middle = right(output, m)
    psm = F.concat(right(left(output, s), p), middle, left(right(output, s), m))
    spm = F.concat(left(right(output, p), m), middle, right(left(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark, sf_dir):
    """doc_id, n, form, lengths of prefix and middle, digests of output and restored text of all ``documents``."""
    from ._io import table

    made = fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units),
cut AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:n], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
