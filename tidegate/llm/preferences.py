"""Preference formatting: the longest common turn prefix of two conversations once as prompt, the rest as completions.

Results are rows of rendered turns, so that no conversation has to fit into one value; the pair's common prefix ends
before the first position at which the two differ, which is an aggregate and not a comparison of whole conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rendered(role: Column, text: Column) -> Column:
    """A turn as text; a null role is "unknown" and a null text is empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def formatted(turns: DataFrame) -> DataFrame:
    """(pair_id, part, position, role, rendered, learned) from ``turns(pair_id, chosen, turn, role, text)``.

    ``chosen`` is true for the turns of the preferred conversation and false for those of the other. ``part`` is
    "prompt" for the common prefix, which comes once, else "chosen" or "rejected"; ``position`` counts a conversation's
    turns from 0 in the order of turn, role and text (nulls first), and repeated turns count each. ``learned`` is the
    mask: true only for an assistant's turns in a completion. A pair of which one side is missing has no prompt; equal
    conversations are all prompt. Rows with a null pair_id are left out.
    """
    order = W.partitionBy("pair_id", "chosen").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    own = turns.select("pair_id", "chosen", "turn", "role", "text").where("pair_id is not null and chosen is not null")
    own = own.withColumn("position", (F.row_number().over(order) - 1).cast("long"))
    # a position is common if it has both sides and these are equal
    same = own.groupBy("pair_id", "position").agg(
        F.count(F.lit(1)).alias("sides"),
        (F.min(F.struct("role", "text")) == F.max(F.struct("role", "text"))).alias("equal"),
    )
    differ = same.groupBy("pair_id").agg(F.min(F.when((F.col("sides") < 2) | ~F.col("equal"), F.col("position"))).alias("fork"))
    parts = own.join(differ, "pair_id").withColumn("common", F.col("fork").isNull() | (F.col("position") < F.col("fork")))
    kept = parts.where("not common or chosen")
    return kept.select(
        "pair_id",
        F.when(F.col("common"), "prompt").when(F.col("chosen"), "chosen").otherwise("rejected").alias("part"),
        "position",
        "role",
        rendered(F.col("role"), F.col("text")).alias("rendered"),
        (~F.col("common") & F.coalesce(F.col("role") == "assistant", F.lit(False))).alias("learned"),
    )


def exchanged_answers(conversations: DataFrame) -> DataFrame:
    """Turns of a pair for each conversation: as it is (chosen), and with the last answer of conversation n ^ 1 in place of
    its own last one (rejected), nothing after it. The two are alike up to there.

    Conversations without an answer, or whose partner has none, are paired with themselves. Answers are turns of an
    assistant; of several last ones in a turn the largest text counts. Rows with a null conv_id are left out.
    """
    conv = F.col("conv_id").cast("long")
    turns = conversations.select(conv.alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text").where("pair_id is not null")
    last = turns.where("role = 'assistant' and turn is not null").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("own"))
    answers = last.select("pair_id", F.col("own.turn").alias("at"))
    others = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("own.text").alias("other"), F.lit(True).alias("known"))
    both = turns.join(answers.join(others, "pair_id"), "pair_id", "left")
    # up to the last answer, which the other one takes the place of
    rejected = both.where("known is null or turn is null or turn < at").select("pair_id", F.lit(False).alias("chosen"), "turn", "role", "text")
    swapped = answers.join(others, "pair_id").select("pair_id", F.lit(False).alias("chosen"), F.col("at").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    return turns.select("pair_id", F.lit(True).alias("chosen"), "turn", "role", "text").unionByName(rejected).unionByName(swapped)


def assembled(rows: DataFrame) -> DataFrame:
    """A row per pair from ``formatted``: prompt, and chosen and rejected as arrays of struct<text, learned>. For pairs
    that fit into one value; ``formatted`` has no such bound."""
    turns = lambda part: F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("position", "rendered", "learned"))))
    segments = lambda name: F.transform(name, lambda t: F.struct(t["rendered"].alias("text"), t["learned"].alias("learned")))
    whole = rows.groupBy("pair_id").agg(*[turns(p).alias(p) for p in ("prompt", "chosen", "rejected")])
    prompt = F.array_join(F.transform("prompt", lambda t: t["rendered"]), "")
    return whole.select("pair_id", prompt.alias("prompt"), segments("chosen").alias("chosen"), segments("rejected").alias("rejected"))
