"""Preference formatting: shared prompt, paired completions, loss masks.

A pair holds a chosen and a rejected conversation.  Their longest common prefix
of turns is rendered once as the prompt; each side's remaining turns are its
completion, with the character spans that bear loss (assistant words and their
end marker, never headers or other roles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
OUTPUT = ("n_common", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans")
TURNS = "array<struct<role:string,text:string>>"


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def render(turns: Column) -> Column:
    """All turns as text, each as a header with the role, its words and an end marker."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t["role"]), t["text"], F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """Spans (start, end) in code points of ``render(turns)`` that bear loss, in order."""

    def add(acc: Column, t: Column) -> Column:
        head = F.length(_header(t["role"]))
        body = F.length(t["text"]) + len(END)
        start = acc["at"] + head
        span = F.array(F.struct(start.alias("start"), (start + body).alias("end")))
        return F.struct(
            (start + body).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, zero, add, lambda acc: acc["spans"])


def conversations_to_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, turns by turn number, then role and text.

    NULL roles and texts become empty, and a NULL turn comes first.  Rows without
    a conv_id belong to no conversation and give none.  Repeated rows are turns
    of their own.  A conversation, however long, is one training example and so
    one row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    gathered = conversations.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), role.alias("role"), text.alias("text")))).alias("t")
    )
    return gathered.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) from plain conversations.

    Chosen is the conversation up to its last assistant turn; rejected has that
    reply replaced by the last reply of conversation conv_id + 1, or left out if
    there is none.  Conversations without an assistant turn give no pair.
    """
    turns = conversations_to_turns(conversations)
    last = F.array_max(
        F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1))
    )
    cut = turns.withColumn("n", last).filter("n is not null").select("conv_id", F.slice("turns", F.lit(1), F.col("n")).alias("chosen"))
    reply = cut.select(F.try_subtract("conv_id", F.lit(1)).alias("conv_id"), F.slice("chosen", -1, 1).alias("other"))
    same_start = F.slice("chosen", F.lit(1), F.size("chosen") - 1)
    return cut.join(reply, "conv_id", "left").select(
        "conv_id", "chosen", F.concat(same_start, F.coalesce("other", F.array().cast(TURNS))).alias("rejected")
    )


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Every other column of ``pairs``, and: n_common, prompt, chosen, rejected, chosen_spans, rejected_spans.

    ``chosen`` and ``rejected`` come in as arrays of (role, text) and go out
    rendered.  Equal sides are all prompt with two empty completions; sides that
    share nothing have an empty prompt; a NULL side counts as without turns.
    Repeated pairs give repeated results; an empty table gives an empty result.
    """
    none = F.array().cast(TURNS)
    others = [c for c in pairs.columns if c not in OUTPUT]
    both = pairs.select(
        *others, F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected")
    )
    differ = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
    split = both.withColumn("n_common", F.when(differ == 0, F.size("chosen")).otherwise(differ - 1))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))

    parts = split.select(*others, "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("prompt"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select(
        *others,
        "n_common",
        render(F.col("prompt")).alias("prompt"),
        render(F.col("c")).alias("chosen"),
        render(F.col("r")).alias("rejected"),
        loss_spans(F.col("c")).alias("chosen_spans"),
        loss_spans(F.col("r")).alias("rejected_spans"),
    )
