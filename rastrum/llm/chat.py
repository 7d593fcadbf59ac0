"""Preference formatting: pairs of conversations as prompt and masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrum.llm.common import let, sums_before

OPEN, CLOSE = "<|turn|>", "<|end|>"


def clean(text: Column) -> Column:
    """Text that can't hold a delimiter: the start of one is parted by a space."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(CLOSE + "\n"))), "")


def learned(turns: Column, role: str) -> Column:
    """start:end of the text of each turn of `role`, with the end mark, in code points of the rendered turns."""
    size = lambda t: F.length(head(t)) + F.length(t["text"]) + len(CLOSE) + 1

    def spans(starts: Column) -> Column:
        begin = lambda t, i: F.get(starts, i) + F.length(head(t))
        each = F.transform(turns, lambda t, i: F.when(t["role"] == role, F.concat_ws(":", begin(t, i).cast("string"), (begin(t, i) + F.length(t["text"]) + len(CLOSE)).cast("string"))))
        return F.array_join(F.filter(each, lambda x: x.isNotNull()), ",")

    return F.when(F.size(turns) == 0, F.lit("")).otherwise(let(sums_before(F.transform(turns, size)), spans))


def preference_pairs(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    turns has pair_id, is_chosen (boolean), turn, role and text.  The prompt is the
    longest common prefix of whole turns, equal in role and text, rendered once; the
    completions are what follows on either side.  A mask lists the spans that are
    learned from, those of `role`, as start:end of code points, comma-joined.

    Turns are ordered by turn, role and text; nulls come first, null roles and texts
    count as empty, and repeated rows are turns of their own.  A side without turns
    is empty, and so is the completion of a side that the other begins with.  Rows
    with a null pair_id or is_chosen belong to no pair.  One shuffle brings a pair's
    turns together; a row of the result holds them all in any case.
    """
    one = F.struct("turn", clean(F.col("role")).alias("role"), clean(F.col("text")).alias("text"))
    side = lambda yes: F.array_sort(F.collect_list(F.when(F.col("is_chosen") == yes, one)))
    known = turns.where(F.col("pair_id").isNotNull() & F.col("is_chosen").isNotNull())
    pairs = known.select("pair_id", "is_chosen", "turn", "role", "text").groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    bare = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    pairs = pairs.select("pair_id", F.transform("c", bare).alias("c"), F.transform("r", bare).alias("r"))
    first = let(F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), F.lit(False)), lambda p: F.when(p > 0, p - 1).otherwise(F.least(F.size("c"), F.size("r"))))
    pairs = pairs.withColumn("n_common", first.cast("long"))
    after = lambda c: F.slice(F.col(c), F.col("n_common").cast("int") + 1, F.greatest(F.size(c), F.lit(1)))
    pairs = pairs.select("pair_id", "n_common", F.slice("c", 1, F.col("n_common").cast("int")).alias("p"), after("c").alias("c"), after("r").alias("r"))
    return pairs.select("pair_id", "n_common", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), learned(F.col("c"), role).alias("chosen_mask"), learned(F.col("r"), role).alias("rejected_mask"))


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of conversations 2k (chosen) and 2k + 1 (rejected) as pair k; null conv_id has no pair."""
    return conversations.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("is_chosen"), "turn", "role", "text")
