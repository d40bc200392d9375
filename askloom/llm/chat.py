"""Chat formatting by multi-party perspective rotation.

A dialogue is rendered once for each of its participants: that speaker's turns
become the assistant's, everybody else's become a named user's, and the mask is
1 on the assistant's content and 0 elsewhere.  A speaker is the value of
``role``; turns are in the order of (turn, role, text).

A turn is rendered as ``<|assistant|>\\n{text}<|end|>\\n`` or
``<|user name={speaker}|>\\n{text}<|end|>\\n``; the loss covers the assistant's
text and its ``<|end|>``.

The result has one row for each (conversation, perspective, part).  A part
holds up to ``PART_TURNS`` consecutive turns, so that no group, however large,
has to fit into one row; parts are numbered from 0 and their texts join
seamlessly.  ``mask`` lists the spans of the text, (start, length) in code
points, whose mask is 1.

Turns are ranked by the counts of range partitions, so that a hot
conversation is spread over tasks.

*Edge cases.*  A null text is rendered as an empty one; a null role is the
speaker ``unknown``; null conversation ids are one conversation; null turns
come first.  Rows that repeat are turns of their own.  A dialogue with one
speaker has one perspective.  An empty table gives an empty one.  Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_ranks

PART_TURNS = 64
UNKNOWN = "unknown"


def rotate_perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, perspective, part, n_turns, n_masked, text, mask of every part of every rendering."""
    if part_turns < 1:
        raise ValueError("a part holds at least one turn")
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
    ranked = global_ranks(said, ["turn", "speaker", "content"], "rank", within=["conv_id"]).select(
        "conv_id", "speaker", "content", "rank", F.floor(F.col("rank") / part_turns).alias("part")
    )
    people = said.select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = ranked.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv"))).drop("p_conv")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(
        F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n"))
    )
    turn = F.struct(
        "rank",
        head.alias("head"),
        F.concat("content", F.lit("<|end|>")).alias("body"),
        own.alias("own"),
    )
    parts = seen.groupBy("conv_id", "perspective", "part").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    # a fold over a part's turns: where each one starts, and the spans of its own ones
    span = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.filter(F.array(span), lambda x: F.lit(False)).alias("spans"))

    def step(s, t):
        start = s["at"] + F.length(t["head"])
        size = F.length(t["body"]).cast("long")
        here = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct(
            (start + size + 1).alias("at"),
            F.when(t["own"], F.concat(s["spans"], here)).otherwise(s["spans"]).alias("spans"),
        )

    mask = F.aggregate("t", zero, step, lambda s: s["spans"])
    text = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")
    return parts.select(
        "conv_id",
        "perspective",
        "part",
        F.size("t").alias("n_turns"),
        F.size(F.filter("t", lambda t: t["own"])).alias("n_masked"),
        text.alias("text"),
        mask.alias("mask"),
    )
