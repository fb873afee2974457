"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose the windows.  A turn that takes over half of a
window's room has one to itself; between such turns the window of a turn is its
prefix over a step that leaves room for the longest of the others, so windows
are turn-aligned, half full at least, and keep within the budget whenever each
turn does.  Every window begins with the conversation's leading system turn, then repeats a
limited history, then has its own turns.  Only the assistant texts among its own
turns are under the loss mask, so each target is trained on once.

The template marks turns; control strings inside texts and roles are broken by
a backslash after their first character, and backslashes are doubled, so that
unescaping is exact.

Defined cases: a null text or role is an empty one; turns order by turn (null
first), then role, then text, and repeated rows are repeated turns; a null
conversation id is one conversation; a conversation without a system turn has no
prefix; a turn over the budget has a window to itself; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Tokens in a window, of which the repeated history may take so many, in so many turns at most.
BUDGET, HISTORY, HISTORY_TURNS = 2048, 256, 2
#: Tokens of a turn's marks.
OVERHEAD = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])", r"$0\\")


def unescape(text: Column) -> Column:
    """A doubled backslash is one, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def tokens(text: Column) -> Column:
    """The default measure of a text's tokens, an estimate that needs no vocabulary: a token for every four bytes."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: Callable[[Column], Column] = tokens) -> DataFrame:
    """(conv_id, n, role, text, tokens, system, window, repeats): the turns by number, each with its own window and those that repeat it.

    ``window`` is null for a leading system turn: all windows have it.
    """
    column = lambda c: F.col(f"`{c}`")
    plain = conversations.select(column(conv_col).alias("conv_id"), column(turn_col).alias("turn"), F.coalesce(column(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cost = plain.withColumn("tokens", tokens(F.col("text")) + OVERHEAD)
    by = cost.withColumn("n", F.row_number().over(order))
    by = by.withColumn("system", (F.col("n") == 1) & (F.col("role") == "system"))
    spent = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    by = by.withColumn("before", F.sum(spent).over(running) - spent)
    prefix = F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(whole)
    by = by.withColumn("room", F.greatest(F.lit(BUDGET - HISTORY) - prefix, F.lit(1)))
    by = by.withColumn("alone", 2 * spent > F.col("room"))
    longest = F.max(F.when(F.col("alone"), 0).otherwise(spent)).over(whole)
    by = by.withColumn("step", F.col("room") - longest + 1)
    # A stretch begins with a turn that is alone, and after one; prefixes do not decrease, so the last beginning is the largest.
    by = by.withColumn("breaks", F.col("alone") | F.coalesce(F.lag("alone").over(order), F.lit(True)))
    by = by.withColumn("part", F.floor((F.col("before") - F.max(F.when(F.col("breaks"), F.col("before"))).over(running)) / F.col("step")))
    opens = F.when(F.col("system"), 0).when(F.col("breaks") | F.lag("system").over(order) | (F.col("part") > F.lag("part").over(order)), 1).otherwise(0)
    by = by.withColumn("window", F.when(~F.col("system"), F.sum(opens).over(running) - 1))
    later = [F.struct(F.lead("window", r).over(order).alias("window"), F.lead("before", r).over(order).alias("before"), F.lead("window", r - 1).over(order).alias("previous")) for r in range(1, HISTORY_TURNS + 1)]
    by = by.withColumn("later", F.array(*later))
    begins = F.filter("later", lambda x: x["window"].isNotNull() & x["previous"].isNotNull() & (x["window"] > x["previous"]) & (x["before"] - F.col("before") <= HISTORY))
    return by.select("conv_id", "n", "role", "text", "tokens", "system", "window", F.when(F.col("system"), F.array().cast("array<bigint>")).otherwise(F.transform(begins, lambda x: x["window"])).alias("repeats"))


def windows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: Callable[[Column], Column] = tokens) -> DataFrame:
    """(conv_id, window, formatted, loss, repeated): one row per window.

    ``loss`` lists the spans (start, stop in code points) of ``formatted`` that
    are trained on; the first ``repeated`` turns are copies of turns that
    another window has as its own.
    """
    parts = turns(conversations, conv_col, turn_col, role_col, text_col, tokens)
    # A leading system turn belongs to the first window and is repeated in every other.
    opens = Window.partitionBy("conv_id", "window")
    by_n = Window.partitionBy("conv_id").orderBy("n")
    parts = parts.withColumn("lead", F.first(F.when(F.col("system"), F.struct("role", "text"))).over(by_n.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = parts.withColumn("window", F.coalesce("window", F.lit(0).cast("long"))).withColumn("opens", ~F.col("system") & (F.col("n") == F.min(F.when(~F.col("system"), F.col("n"))).over(opens)))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    body = escape(F.col("text"))
    own = F.struct(F.col("window").alias("window"), F.lit(False).alias("again"))
    again = F.transform("repeats", lambda w: F.struct(w.alias("window"), F.lit(True).alias("again")))
    placed = parts.select(
        "conv_id",
        F.col("n").alias("n"),
        head.alias("head"),
        body.alias("body"),
        (F.col("role") == "assistant").alias("target"),
        F.when(F.col("opens") & (F.col("window") > 0) & F.col("lead").isNotNull(), F.concat(F.lit(START), escape(F.col("lead.role")), F.lit(SEP), escape(F.col("lead.text")), F.lit(END))).otherwise("").alias("lead"),
        F.explode(F.concat(F.array(own), again)).alias("at"),
    )
    turn = F.struct("n", "head", "body", "target", "lead", F.col("at.again").alias("again"))
    grouped = placed.groupBy("conv_id", F.col("at.window").alias("window")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # The system turn's copy stands on the window's opening turn, which history may precede.
    prefix = F.array_join(F.transform("turns", lambda t: F.when(t["again"], F.lit("")).otherwise(t["lead"])), "")
    grouped = grouped.withColumn("prefix", prefix)
    whole = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    state = F.struct(F.length("prefix").alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("loss"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        stop = start + F.length(t["body"])
        return F.struct((stop + len(END)).alias("at"), F.when(t["target"] & ~t["again"], F.array_append(acc["loss"], F.struct(start.alias("start"), stop.alias("stop")))).otherwise(acc["loss"]).alias("loss"))

    return grouped.select(
        "conv_id",
        "window",
        F.concat("prefix", F.array_join(F.transform("turns", whole), "")).alias("formatted"),
        F.aggregate("turns", state, step, lambda a: a["loss"]).alias("loss"),
        (F.size(F.filter("turns", lambda t: t["again"])) + (F.length("prefix") > 0).cast("int")).alias("repeated"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the windows alone."""
    marked = F.split("formatted", r"<\|im_end\|>", -1)
    turn = F.transform(F.slice(marked, F.col("repeated") + 1, F.size(marked) - 1 - F.col("repeated")), lambda t: F.split(F.substring(t, len(START) + 1, 1 << 30), r"<\|im_sep\|>", -1))
    said = F.array_join(F.transform(turn, lambda t: F.concat(unescape(t[0]), F.lit("\n"), unescape(t[1]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["stop"] - s["start"]))), "")
    each = formatted.select("conv_id", F.struct("window", F.size(turn).cast("long").alias("n"), said.alias("said"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    joined = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    total = lambda f: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[f])
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


#: The same digests in DuckDB, from the turns themselves; ``formatted_chars`` adds up the windows that hold each turn.
ORACLE = rf"""
WITH plain AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER w AS n, CAST(ceil(strlen(text) / 4) AS BIGINT) + {OVERHEAD} AS tokens,
    row_number() OVER w = 1 AND role = 'system' AS system
  FROM plain WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, CASE WHEN system THEN 0 ELSE tokens END AS spent,
    length(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>|</?SYS>>)|\[(/?INST\])', '<\\\1\2', 'g')) + length(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>)|\[(/?INST\])', '<\\\1\2', 'g')) + {len(START + SEP + END)} AS chars
  FROM numbered
), roomy AS (
  SELECT *, sum(spent) OVER (PARTITION BY conv_id ORDER BY n) - spent AS before,
    greatest({BUDGET - HISTORY} - max(CASE WHEN system THEN tokens ELSE 0 END) OVER c, 1) AS room,
    max(CASE WHEN system THEN chars ELSE 0 END) OVER c AS lead_chars
  FROM summed WINDOW c AS (PARTITION BY conv_id)
), stepped AS (
  SELECT *, 2 * spent > room AS alone, room + 1 - max(CASE WHEN 2 * spent > room THEN 0 ELSE spent END) OVER (PARTITION BY conv_id) AS step FROM roomy
), broken AS (
  SELECT *, alone OR coalesce(lag(alone) OVER (PARTITION BY conv_id ORDER BY n), true) AS breaks FROM stepped
), parted AS (
  SELECT *, CAST(floor((before - max(CASE WHEN breaks THEN before END) OVER (PARTITION BY conv_id ORDER BY n)) / step) AS BIGINT) AS part FROM broken
), opened AS (
  SELECT *, CASE WHEN system THEN 0 WHEN breaks OR lag(system) OVER o OR part > lag(part) OVER o THEN 1 ELSE 0 END AS opens FROM parted WINDOW o AS (PARTITION BY conv_id ORDER BY n)
), windowed AS (
  SELECT *, CASE WHEN NOT system THEN CAST(sum(opens) OVER (PARTITION BY conv_id ORDER BY n) - 1 AS BIGINT) END AS win FROM opened
), repeated AS (
  SELECT *, {" + ".join(f"CASE WHEN NOT system AND lead(win, {r}) OVER o > lead(win, {r - 1}) OVER o AND lead(before, {r}) OVER o - before <= {HISTORY} THEN 1 ELSE 0 END" for r in range(1, HISTORY_TURNS + 1))} AS again
  FROM windowed WINDOW o AS (PARTITION BY conv_id ORDER BY n)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars * (1 + again)) + greatest(count(DISTINCT win) FILTER (win > 0), 0) * max(lead_chars))::BIGINT AS formatted_chars
FROM repeated GROUP BY conv_id
"""
