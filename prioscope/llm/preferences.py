"""Chat formatting: preference pairs with a shared prompt and masked completions.

The longest common prefix of turns of a chosen and a rejected conversation is
rendered once as the prompt; what follows in each is a completion whose mask
marks what a model may learn from: the words of assistant turns and their end
mark, not headers and not other roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import column

REPLY_ROLE = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and `turns`, an array of (turn, role, text) in order.

    Turns with equal numbers are ordered by role and text, null numbers come
    first. Null roles count as "unknown", null texts as empty. Rows without
    conv_id belong to no conversation and are left out. A conversation is one
    record of the result, so its turns meet in one row, whatever their number.
    """
    turn = F.struct(column("turn").alias("turn"), F.coalesce(column("role"), F.lit("unknown")).alias("role"),
                    F.coalesce(column("text"), F.lit("")).alias("text"))
    return turns.where(column("conv_id").isNotNull()).groupBy(column("conv_id").alias("conv_id")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))


def swapped_replies(talks: DataFrame) -> DataFrame:
    """Preference pairs: conv_id, other_id, chosen, rejected (arrays of turns).

    Chosen is a conversation up to its last reply; rejected is the same with
    that reply replaced by the last reply of the neighbouring conversation
    (2k and 2k + 1). Conversations without a reply on either side give no pair.
    """
    from_end = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == REPLY_ROLE)), True)
    upto = talks.where(from_end > 0).select(
        "conv_id", F.slice("turns", F.lit(1), (F.size("turns") - from_end + 1).cast("int")).alias("chosen"))
    replies = upto.select(F.col("conv_id").alias("other_id"), F.element_at("chosen", -1)["text"].alias("reply"))
    upto = upto.withColumn("other_id", F.col("conv_id").bitwiseXOR(F.lit(1).cast("bigint")))
    last = F.element_at("chosen", -1)
    swapped = F.struct(last["turn"].alias("turn"), last["role"].alias("role"), F.col("reply").alias("text"))
    return upto.join(replies, "other_id").select(
        "conv_id", "other_id", "chosen",
        F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.array(swapped)).alias("rejected"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Adds to pairs (arrays `chosen`, `rejected`) the prompt and both completions with masks, and drops the arrays.

    Columns added: n_prompt_turns, prompt, chosen_text, chosen_mask,
    rejected_text, rejected_mask. A mask is a run-length list "bit:characters"
    that covers its completion. Turns are equal when role and text are. Equal
    conversations are all prompt and leave empty completions and masks; pairs
    with nothing in common have an empty prompt. A null array counts as empty.
    """
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    sides = pairs.withColumns({c: F.coalesce(F.col(c), empty) for c in ("chosen", "rejected")})
    same = F.zip_with("chosen", "rejected", lambda a, b: a.isNotNull() & b.isNotNull()
                      & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first_difference = F.array_position(same, False)
    sides = sides.withColumn("n_prompt_turns", F.when(first_difference == 0, F.size("chosen")).otherwise(
        first_difference - 1).cast("int"))
    out = sides.withColumn("prompt", _rendered(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))))
    for side in ("chosen", "rejected"):
        rest = F.slice(side, F.col("n_prompt_turns") + 1, F.size(side))
        out = out.withColumns({f"{side}_text": _rendered(rest), f"{side}_mask": _mask(rest)})
    return out.drop("chosen", "rejected")


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), turn["role"], F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|im_end|>"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t), F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    def runs(turn: Column) -> Column:
        head, body = F.length(_header(turn)).cast("string"), F.length(_body(turn)).cast("string")
        reply = F.concat(F.lit("0:"), head, F.lit(",1:"), body, F.lit(",0:1"))
        other = F.concat(F.lit("0:"), (F.length(_header(turn)) + F.length(_body(turn)) + 1).cast("string"))
        return F.when(turn["role"] == REPLY_ROLE, reply).otherwise(other)

    return F.array_join(F.transform(turns, runs), ",")
