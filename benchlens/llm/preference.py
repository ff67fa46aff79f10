"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The longest run of equal first turns of the chosen and the rejected
conversation is rendered once as the prompt; what is left of each side is its
completion. A completion's mask lists run lengths over its characters, so that
only assistant turns are learnt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlens.operators.ordered import running

LEARNT = ("assistant",)


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def body(text: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    """Text of an array of (role, text) turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t["role"]), body(t["text"]))), "")


def mask(turns: Column, learnt: tuple[str, ...] = LEARNT) -> Column:
    """Runs "length:weight" that cover the rendered turns: weight 1 for the bodies of ``learnt`` roles."""
    def runs(t: Column) -> Column:
        weight = F.when(t["role"].isin(*learnt), ":1").otherwise(":0")
        return F.concat(F.length(header(t["role"])), F.lit(":0,"), F.length(body(t["text"])), weight)

    return F.array_join(F.transform(turns, runs), ",")


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): each conversation's (role, text) turns by turn number, then role and text, nulls first."""
    own = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"),
                                            F.col(text).cast("string").alias("text")).alias("t"))
    got = own.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return got.select("conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """How many first turns are the same in role and text (nulls equal each other)."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n),
                      lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    at = F.array_position(same, False).cast("int")
    return F.when(at > 0, at - 1).otherwise(n)


def format_pairs(turns: DataFrame, pairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row for each row of ``pairs`` (pair_id, chosen_id, rejected_id).

    Returns pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen,
    rejected, chosen_mask, rejected_mask. Prompt and completion put together
    are the whole rendered conversation. Equal conversations give empty
    completions; where one is the beginning of the other, its completion is
    empty; a side whose id is null or names no turn has no turns. A null role
    or text is rendered as empty. Turns without a conversation id take no
    part; turns that repeat or share a number are all kept, by number, role and
    text. Repeated rows of ``pairs`` count once, and pair ids must otherwise be
    unique. Empty tables give an empty result; other columns are not read. A
    conversation must fit a row, as it does in the result.
    """
    convs = conversations(turns, conv, turn, role, text)
    each = pairs.select("pair_id", "chosen_id", "rejected_id").distinct()
    sides = each.select("pair_id", "chosen_id", "rejected_id", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), F.col("chosen_id").alias("conv")),
        F.struct(F.lit(False).alias("first"), F.col("rejected_id").alias("conv")))).alias("s")).select(
        "pair_id", "chosen_id", "rejected_id", "s.first", "s.conv")
    none = F.array().cast(convs.schema["turns"].dataType)
    # sides without an id have nothing to meet; in the join they would all be one key
    here = sides.where(F.col("conv").isNotNull()).join(convs, "conv", "left")
    met = here.unionByName(sides.where(F.col("conv").isNull()), allowMissingColumns=True).groupBy("pair_id", "chosen_id", "rejected_id").agg(
        F.coalesce(F.first(F.when(F.col("first"), F.col("turns")), ignorenulls=True), none).alias("a"),
        F.coalesce(F.first(F.when(~F.col("first"), F.col("turns")), ignorenulls=True), none).alias("b"))
    cut = met.withColumn("prompt_turns", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c), F.lit(1)))
    cut = cut.withColumns({"ra": rest("a"), "rb": rest("b")})
    return cut.select("pair_id", "chosen_id", "rejected_id", "prompt_turns",
                      render(F.slice("a", 1, F.col("prompt_turns"))).alias("prompt"),
                      render(F.col("ra")).alias("chosen"), render(F.col("rb")).alias("rejected"),
                      mask(F.col("ra")).alias("chosen_mask"), mask(F.col("rb")).alias("rejected_mask"))


def pairs_by_opening(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                     text: str = "text") -> DataFrame:
    """(pair_id, chosen_id, rejected_id): conversations that open with the same turn, two by two.

    In the order of their ids, the first is chosen and the second rejected, the
    third chosen and so on; pair_id is the chosen id. One that is left over has
    a null rejected id, so every conversation is in exactly one pair. The
    numbering inside an opening is cut into ranges, so a very frequent opening
    is not one task's work.
    """
    own = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.struct(
        F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).alias("t"))
    first = own.groupBy("conv").agg(F.min("t").alias("t")).select(
        "conv", F.xxhash64(F.col("t.role").isNull(), "t.role", F.col("t.text").isNull(), "t.text").alias("opening"))
    at = running(first, ["opening"], ["conv"], index="i")
    pair = F.floor((F.col("i") - 1) / 2).alias("pair")
    return at.groupBy("opening", pair).agg(
        F.min("conv").alias("pair_id"), F.min("conv").alias("chosen_id"),
        F.max(F.when(F.col("i") % 2 == 0, F.col("conv"))).alias("rejected_id")).drop("opening", "pair")
