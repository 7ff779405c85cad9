"""Preference formatting of conversation pairs (DataFrame functions only).

A pair is a chosen and a rejected conversation. The longest common prefix of their turns is
rendered once, as the prompt; what follows is rendered for each side as its completion, with a mask
that trains on assistant turns alone.

Defined results: turns go by (turn, role, text), nulls first; a null role or text is rendered as
empty and equals only null; rows without a conversation id belong to no conversation and are left
out; a pair of which one side is missing has ``status`` ``unpaired``, a null completion there and
an empty prompt; a pair that never parts has ``identical`` and empty completions; of several
conversations on one side of a pair the one with the smallest id counts; repeated turns are turns of their own; an empty table gives an
empty table; columns beyond the four named ones are left out. One shuffle by
pair; a conversation is a row in the end, so it is held whole, and no group beyond it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"


def _head(t: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(TAIL))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Runs ``length:flag`` that cover the rendered text; flag 1 is trained on."""
    run = lambda t: F.concat(
        F.length(_head(t)).cast("string"), F.lit(":0,"), F.length(_body(t)).cast("string"),
        F.when(t["role"] == "assistant", F.lit(":1")).otherwise(F.lit(":0")),
    )
    return F.array_join(F.transform(turns, run), ",")


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""

    def of(both: Column) -> Column:
        x, y = both["a"], both["b"]
        shorter = F.least(F.size(x), F.size(y))
        parts = F.filter(
            F.transform(F.slice(x, 1, shorter), lambda t, i: F.when(
                ~(t["role"].eqNullSafe(F.get(y, i)["role"]) & t["text"].eqNullSafe(F.get(y, i)["text"])), i
            )),
            lambda i: i.isNotNull(),
        )
        return F.coalesce(F.get(parts, F.lit(0)), shorter)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair. ``pair`` names the pair of a turn's conversation, ``chosen`` its side.

    Columns: pair_id, chosen_id, rejected_id, status, n_prompt_turns, prompt, chosen, rejected,
    chosen_mask, rejected_mask.
    """
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = turns.where(F.col(conv).isNotNull()).select(pair.alias("pair_id"), chosen.alias("side"), F.col(conv).alias("conv"), one.alias("t"))
    side = lambda yes: F.col("side") if yes else ~F.col("side")
    gathered = rows.groupBy("pair_id").agg(
        F.min(F.when(side(True), F.col("conv"))).alias("chosen_id"),
        F.min(F.when(side(False), F.col("conv"))).alias("rejected_id"),
        F.sort_array(F.collect_list(F.when(side(True), F.struct("conv", "t")))).alias("a"),
        F.sort_array(F.collect_list(F.when(side(False), F.struct("conv", "t")))).alias("b"),
    )
    own = lambda turns: F.transform(F.filter(turns, lambda x: x["conv"] == F.get(turns, F.lit(0))["conv"]), lambda x: x["t"])
    gathered = gathered.withColumns({c: let(F.col(c), own) for c in "ab"})
    both = (F.size("a") > 0) & (F.size("b") > 0)
    n = F.when(both, common_turns(F.col("a"), F.col("b"))).otherwise(F.lit(0))

    def out(x: Column) -> Column:
        a, b, n = x["a"], x["b"], x["n"]
        rest = lambda s: F.slice(s, n + 1, F.greatest(F.size(s) - n, F.lit(0)))
        here = lambda s, f: F.when(F.size(s) > 0, f(rest(s)))
        return F.struct(
            F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit("unpaired"))
            .when((n == F.size(a)) & (n == F.size(b)), F.lit("identical"))
            .otherwise(F.lit("paired")).alias("status"),
            n.cast("long").alias("n_prompt_turns"),
            render(F.slice(a, 1, n)).alias("prompt"),
            here(a, render).alias("chosen"), here(b, render).alias("rejected"),
            here(a, mask).alias("chosen_mask"), here(b, mask).alias("rejected_mask"),
        )

    made = let(F.struct(F.col("a").alias("a"), F.col("b").alias("b"), n.alias("n")), out)
    return gathered.select("pair_id", "chosen_id", "rejected_id", made.alias("m")).select("pair_id", "chosen_id", "rejected_id", "m.*")
