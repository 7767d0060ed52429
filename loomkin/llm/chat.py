"""Preference formatting.

A pair is a chosen and a rejected conversation. The turns on which both agree, from the first on, are
rendered once as the prompt; what remains of each becomes its completion, with the character spans
(start inclusive, end exclusive) of the assistant's own words as the loss mask. One shuffle, by pair.

The query's pairs are mismatches: a conversation is chosen; rejected is the same conversation with its last
answer taken from the next one. Both agree on all turns before that answer.

Defined results: turns stand in the order of their turn number; rows of one conversation with the same
number stand by role and text, and exact repeats count once. A null role renders as `unknown`, a null
text as empty. `<|` inside a text or role is rendered `< |`, and a role's line breaks as blanks, so that
neither can forge a boundary. A missing side has no turns: then the prompt is empty. usable says whether
both completions hold words of the assistant's; pairs that are not stay in the result, to be left out of
training (equal conversations, a missing side). Rows with a null conv_id have no conversation and are
left out; a null turn comes first. An empty table gives no rows. A conversation is one row of the
result, so one task holds it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkin.llm.common import let, table


def _open(t: Column) -> Column:
    return F.concat(F.lit("<|start|>"), t["role"], F.lit("\n"))


def _close(t: Column) -> Column:
    return F.concat(t["text"], F.lit("<|end|>\n"))


def _turn(t: Column) -> Column:
    return F.concat(_open(t), _close(t))


def rendered_turns(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def mask_of(turns: Column) -> Column:
    """Spans of the assistant's words in rendered_turns(turns), as `start:end` joined by commas."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_open(t))
        end = start + F.length(t["text"])
        span = F.when(t["role"] == "assistant", F.array(F.concat_ws(":", start.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((acc["at"] + F.length(_turn(t))).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step)["spans"], ",")


def _one() -> Column:
    """A turn as it is compared and rendered."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    role = F.translate(F.replace(F.coalesce("role", F.lit("unknown")), F.lit("<|"), F.lit("< |")), "\r\n", "  ")
    return F.struct(F.col("turn"), role.alias("role"), text.alias("text"))


def preference_rows(turns: DataFrame, pairs: Column, chosen: Column) -> DataFrame:
    """One row for each pair.

    turns: conv_id, turn, role, text. pairs: the pair of a turn's conversation. chosen: whether the
    conversation is the pair's chosen one.
    """
    own = turns.where(F.col("conv_id").isNotNull()).select(pairs.alias("pair_id"), chosen.alias("is_chosen"), _one().alias("t"))
    side = lambda flag: F.sort_array(F.collect_set(F.when(F.col("is_chosen") == flag, F.col("t"))))
    return formatted(own.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r")))


def mismatched_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, c, r): each conversation, and it with its last answer replaced by that of conversation conv_id + 1.

    Without an answer on either side r is empty. One shuffle: an answer goes to its own and to the previous conversation.
    """
    key = F.col("conv_id").cast("long")
    to = F.array(F.struct(key.alias("pair_id"), F.lit(False).alias("other")), F.struct((key - 1).alias("pair_id"), F.lit(True).alias("other")))
    each = turns.where(F.col("conv_id").isNotNull()).select(F.explode(F.when(F.col("role") == "assistant", to).otherwise(F.slice(to, 1, 1))).alias("to"), _one().alias("t"))
    own = each.groupBy("to.pair_id").agg(F.sort_array(F.collect_set(F.when(~F.col("to.other"), F.col("t")))).alias("c"), F.max(F.when(F.col("to.other"), F.col("t"))).alias("reply")).where(F.size("c") > 0)
    last = F.array_max(F.filter(F.sequence(F.lit(0), F.size("c") - 1), lambda i: F.get("c", i)["role"] == "assistant"))
    answer = F.struct(F.get("c", F.col("last"))["turn"].alias("turn"), F.lit("assistant").alias("role"), F.col("reply.text").alias("text"))
    found = F.col("last").isNotNull() & F.col("reply").isNotNull()
    return own.withColumn("last", last).select("pair_id", "c", F.when(found, F.concat(F.slice("c", F.lit(1), F.col("last")), F.array(answer))).otherwise(F.slice("c", 1, 0)).alias("r"))


def formatted(both: DataFrame) -> DataFrame:
    """One row for each pair (pair_id, c, r) of ordered turns: the common prompt and the masked completions."""

    def differs(c: Column, r: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.least(F.size(c), F.size(r))), lambda i: (i == F.least(F.size(c), F.size(r))) | ~F.get(c, i).eqNullSafe(F.get(r, i)))
        return F.get(at, F.lit(0))

    split = both.withColumn("n_prompt", let(F.struct("c", "r"), lambda x: differs(x["c"], x["r"])))
    rest = lambda side: F.filter(F.col(side), lambda t, i: i >= F.col("n_prompt"))
    out = split.select(
        "pair_id",
        F.col("n_prompt").cast("long").alias("n_prompt"),
        (F.size("c") - F.col("n_prompt")).cast("long").alias("n_chosen"),
        (F.size("r") - F.col("n_prompt")).cast("long").alias("n_rejected"),
        rendered_turns(F.slice(F.col("c"), F.lit(1), F.col("n_prompt"))).alias("prompt"),
        rendered_turns(rest("c")).alias("chosen"),
        rendered_turns(rest("r")).alias("rejected"),
        mask_of(rest("c")).alias("chosen_mask"),
        mask_of(rest("r")).alias("rejected_mask"),
    )
    return out.withColumn("usable", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != ""))


def op5_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(mismatched_pairs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


OP5_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, replace(replace(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10), ' '), chr(13), ' ') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id AS pair_id, TRUE AS is_chosen, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
a AS (SELECT pair_id, max(k) AS la, arg_max(turn, k) AS turn, arg_max(text, k) AS text FROM c WHERE role = 'assistant' GROUP BY pair_id),
m AS (SELECT a.pair_id, a.la, (SELECT turn FROM c WHERE c.pair_id = a.pair_id AND c.k = a.la) AS turn, n.text FROM a JOIN a n ON n.pair_id = a.pair_id + 1),
r AS (
  SELECT c.pair_id, FALSE AS is_chosen, c.turn, c.role, c.text, c.k FROM c JOIN m ON m.pair_id = c.pair_id AND c.k < m.la
  UNION ALL SELECT pair_id, FALSE, turn, 'assistant', text, la FROM m),
o AS (SELECT * FROM c UNION ALL SELECT * FROM r),
j AS (
  SELECT c.pair_id, coalesce(c.k, r.k) AS k,
         coalesce(c.k = r.k AND c.turn IS NOT DISTINCT FROM r.turn AND c.role = r.role AND c.text = r.text, FALSE) AS same
  FROM c LEFT JOIN r ON c.pair_id = r.pair_id AND c.k = r.k),
n AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN k END) - 1, max(k)) AS n_prompt FROM j GROUP BY pair_id),
s AS (
  SELECT o.*, n_prompt, k <= n_prompt AS in_prompt, '<|start|>' || role || chr(10) AS head, '<|start|>' || role || chr(10) || text || '<|end|>' || chr(10) AS body
  FROM o JOIN n USING (pair_id)),
w AS (
  SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY pair_id, is_chosen, in_prompt ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS b
  FROM s)
SELECT pair_id, CAST(any_value(n_prompt) AS BIGINT) AS n_prompt,
       CAST(count(*) FILTER (WHERE is_chosen AND NOT in_prompt) AS BIGINT) AS n_chosen,
       CAST(count(*) FILTER (WHERE NOT is_chosen AND NOT in_prompt) AS BIGINT) AS n_rejected,
       coalesce(string_agg(body, '' ORDER BY k) FILTER (WHERE is_chosen AND in_prompt), '') AS prompt,
       coalesce(string_agg(body, '' ORDER BY k) FILTER (WHERE is_chosen AND NOT in_prompt), '') AS chosen,
       coalesce(string_agg(body, '' ORDER BY k) FILTER (WHERE NOT is_chosen AND NOT in_prompt), '') AS rejected,
       coalesce(string_agg(b || ':' || (b + length(text)), ',' ORDER BY k) FILTER (WHERE is_chosen AND NOT in_prompt AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(b || ':' || (b + length(text)), ',' ORDER BY k) FILTER (WHERE NOT is_chosen AND NOT in_prompt AND role = 'assistant'), '') AS rejected_mask,
       count(*) FILTER (WHERE is_chosen AND NOT in_prompt AND role = 'assistant') > 0 AND count(*) FILTER (WHERE NOT is_chosen AND NOT in_prompt AND role = 'assistant') > 0 AS usable
FROM w GROUP BY pair_id
"""
