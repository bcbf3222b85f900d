"""Operator 4, chat formatting: event-sourced reconstruction, DataFrame functions only.

An event log has conv_id, seq, op, msg, role and text.  Logs are partitioned by
conversation and sorted by seq; events fold into final messages:

* ``message`` starts message ``msg`` (again) with a text, ``delta`` appends to it,
  ``edit`` replaces its text, ``regenerate`` empties it and drops every later
  message that was there before.

Rendering: each turn is ``<s>`` role ``<sep>`` text ``</s>``; a user's text
stands in ``[INST] `` and `` [/INST]``.  A backslash in a text is doubled and one
is put after the first character of any control string, so no text holds a
control string and unescaping (a backslash yields the character after it)
restores it.  The loss mask lists the places of assistant texts.

One exchange, by conversation, serves the windows, the fold and the rendering.
A conversation is one output string, so it is one task's work and less than 2 GB;
its windows spill.  Null texts and roles are empty; null seq sorts first, ties by
msg, op, role, text; null conv_id is one conversation.  Rows that are fully
repeated are events each.  An empty log gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Control strings of the template.
CONTROL = ("<s>", "</s>", "<sep>", "[INST]", "[/INST]")


def escape(c):
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for x in CONTROL:
        c = F.replace(c, F.lit(x), F.lit(x[0] + "\\" + x[1:]))
    return c


def unescape(c):
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, role, text, in msg order per conversation."""
    log = events.select("conv_id", "seq", F.coalesce("op", F.lit("message")).alias("op"), "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("seq"), F.col("msg"), F.col("op"), F.col("role"), F.col("text")]
    conv = Window.partitionBy("conv_id").orderBy(*order)
    later = conv.rowsBetween(1, Window.unboundedFollowing)
    numbered = log.withColumn("n", F.row_number().over(conv)).withColumn("cut", F.min(F.when(F.col("op") == "regenerate", F.col("msg"))).over(later))
    alive = numbered.where(F.col("cut").isNull() | (F.col("cut") >= F.col("msg")))
    # an event matters from the last one that sets the whole text; found in the sorted events of the message
    per = alive.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(F.struct("n", "op", "role", "text"))).alias("e"))
    last = F.array_max(F.transform(F.filter("e", lambda x: x["op"] != "delta"), lambda x: x["n"]))
    kept = F.filter("e", lambda x: x["n"] >= F.coalesce(F.col("last"), F.lit(0)))
    return per.withColumn("last", last).select(
        "conv_id", "msg", F.element_at("e", 1)["role"].alias("role"), F.array_join(F.transform(kept, lambda x: F.when(x["op"] == "regenerate", F.lit("")).otherwise(x["text"])), "").alias("text")
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: array of (start, length), places of assistant texts in code points from 0."""
    user = F.col("role") == "user"
    head = F.concat(F.lit("<s>"), escape(F.col("role")), F.lit("<sep>"), F.when(user, F.lit("[INST] ")).otherwise(F.lit("")))
    tail = F.concat(F.when(user, F.lit(" [/INST]")).otherwise(F.lit("")), F.lit("</s>"))
    turns = messages.select("conv_id", "msg", (F.col("role") == "assistant").alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"), tail.alias("tail"))
    turns = turns.withColumn("turn", F.concat("head", "body", "tail"))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)) + F.char_length("head"))
    all_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "turn", "loss", "at", F.char_length("body").alias("n")))).alias("t"))
    return all_turns.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["at"].alias("start"), x["n"].alias("length"))).alias("loss"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Read back from the output alone: turns as array of (role, text), and the text under the loss mask."""
    inner = F.transform(F.filter(F.split(F.col("formatted"), "</s>", -1), lambda x: x != ""), lambda x: F.split(F.substring(x, 4, 2147483647), "<sep>", 2))
    turns = F.transform(inner, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(F.when(p[0] == "user", F.regexp_replace(p[1], r"(?s)^\[INST\] (.*) \[/INST\]$", "$1")).otherwise(p[1])).alias("text")))
    masked = F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"].cast("int") + 1, x["length"]))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), masked.alias("loss_text"))


def events_of(conversations: DataFrame) -> DataFrame:
    """Whole messages as events: one per row, in turn order; ties by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", F.row_number().over(order).cast("long").alias("msg"), "role", "text").select("conv_id", F.col("msg").alias("seq"), F.lit("message").alias("op"), "msg", "role", "text")


def query(spark, sf_dir):
    from ._io import table

    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1, 3, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 1, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra)
    back = parse(render(fold_events(events_of(rows))))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 1, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 2, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '<sep>', '<\sep>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS body FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(body) + length(role) + 12 + CASE WHEN role = 'user' THEN 15 ELSE 0 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
