"""Preference formatting of conversation pairs, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import workspace
from graphloom.operators.skew import join_totals

#: The markers of the ChatML template.
START, END = "<|im_start|>", "<|im_end|>"
LAST = (1 << 63) - 1
#: Turn numbers of one row of a formatted pair.
PART_TURNS = 4096


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs conversations 2k (chosen) and 2k + 1 (rejected) as pair k; rows without conv_id are in no pair."""
    conv = F.col("conv_id").cast("long")
    return turns.where(conv.isNotNull()).select(
        ((conv - F.pmod(conv, F.lit(2))) / 2).cast("long").alias("pair_id"), (F.pmod(conv, F.lit(2)) == 0).alias("chosen"), "turn", "role", "text"
    )


def sided(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """The turns of given pairs (pair_id, chosen_id, rejected_id)."""
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(True).alias("chosen"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(False).alias("chosen"), F.col("rejected_id").alias("conv_id")))).alias("s"))
    return sides.select("pair_id", "s.*").join(turns, "conv_id").select("pair_id", "chosen", "turn", "role", "text")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def segments(sides: DataFrame) -> DataFrame:
    """pair_id, segment, turn, role, rendered, loss, times from (pair_id, chosen, turn, role, text).

    The prompt of a pair is its longest common prefix: all turns before the first turn number at
    which the two sides don't hold the same roles and texts.  It is rendered once, as segment
    ``prompt`` with loss 0; later turns are segments ``chosen`` and ``rejected``, with loss 1 on
    those of the assistant.  Order a segment by turn.  A side without later turns has no rows
    in its segment.  A null role counts as ``user``, a null text as empty, a null turn as the
    last; rows that occur several times on a side are rendered once, with their number in ``times``.  An empty table gives none.

    Every step is keyed by pair and turn or by pair with partial aggregation, and a conversation
    is never gathered in one row, so one of any length is dealt over many tasks.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn")
    rows = sides.select("pair_id", "chosen", turn, F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.groupBy("pair_id", "turn", "role", "text").agg(
        F.count(F.when(F.col("chosen"), 1)).alias("c"), F.count(F.when(~F.col("chosen"), 1)).alias("r")
    )
    cuts = workspace.keep(counted.groupBy("pair_id").agg(F.min(F.when(F.col("c") != F.col("r"), F.col("turn"))).alias("cut"), F.count(F.lit(1)).alias("n")), "chat-cuts")
    total = cuts.agg(F.sum("n")).first()[0] or 0
    placed = join_totals(counted, cuts, ["pair_id"], "n", total).withColumn("_shared", F.coalesce(F.col("turn") < F.col("cut"), F.lit(True)))
    dealt = placed.select("*", F.explode(F.when(F.col("_shared"), F.array(F.struct(F.lit("prompt").alias("segment"), F.col("c").alias("times")))).otherwise(
        F.array(F.struct(F.lit("chosen").alias("segment"), F.col("c").alias("times")), F.struct(F.lit("rejected").alias("segment"), F.col("r").alias("times")))
    )).alias("s")).select("*", "s.*").where("times > 0")
    loss = (F.col("segment") != "prompt") & (F.col("role") == "assistant")
    return dealt.select(
        "pair_id", "segment", F.nullif(F.col("turn"), F.lit(LAST)).alias("turn"), "role",
        rendered(F.col("role"), F.col("text")).alias("rendered"), loss.cast("int").alias("loss"), "times",
    )


def format_pairs(sides: DataFrame) -> DataFrame:
    """pair_id, part, prompt, chosen, rejected, chosen_loss, rejected_loss, turns from (pair_id, chosen, turn, role, text).

    A row for each pair: the longest common turn prefix as ``prompt``, rendered once, and the rest of
    each side as a completion, empty where a side has none; see ``segments`` for prefix, nulls and
    repeats.  The masks list the characters that carry loss, as [start, end) of a completion: the
    texts of the assistant's turns with their end marker.  ``turns`` counts those of all three.

    A pair with turn numbers of ``PART_TURNS`` and more gives a row for each range of so many, numbered by
    ``part``, to be read one after the other, so that no row holds a conversation of unbounded
    length; turns without a number stand in part null, the last.  Turns of one number go by role and text.
    """
    ordered = F.struct(F.coalesce("turn", F.lit(LAST)).alias("turn"), "role", "rendered", "loss")
    grouped = segments(sides).groupBy("pair_id", F.floor(F.col("turn") / PART_TURNS).cast("long").alias("part")).agg(F.collect_list(F.struct("segment", ordered.alias("o"))).alias("_all"))
    side = lambda name: F.transform(F.array_sort(F.filter("_all", lambda x: x["segment"] == name)), lambda x: x["o"])
    told = grouped.select("pair_id", "part", F.size("_all").cast("long").alias("turns"), *[side(name).alias(f"_{name}") for name in ("prompt", "chosen", "rejected")])
    text = lambda name: F.array_join(F.col(f"_{name}.rendered"), "")

    def spans(name: str) -> Column:
        none = F.array().cast("array<struct<start:long,end:long>>")
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

        def add(s: Column, x: Column) -> Column:
            end = s["at"] + F.length(x["rendered"])
            mask = F.struct((s["at"] + F.length(F.lit(START)) + F.length(x["role"]) + 1).cast("long").alias("start"), (end - 1).cast("long").alias("end"))
            return F.struct(end.cast("long").alias("at"), F.when(x["loss"] == 1, F.concat(s["spans"], F.array(mask))).otherwise(s["spans"]).alias("spans"))

        return F.aggregate(F.col(f"_{name}"), start, add)["spans"]

    return told.select(
        "pair_id", "part", text("prompt").alias("prompt"), text("chosen").alias("chosen"), text("rejected").alias("rejected"),
        spans("chosen").alias("chosen_loss"), spans("rejected").alias("rejected_loss"), "turns",
    )


def spelled(formatted: DataFrame) -> DataFrame:
    """The masks as text: start-end,start-end."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return formatted.withColumns({c: text(c) for c in ("chosen_loss", "rejected_loss")})


ORACLE = rf"""
    with rows as (select cast(floor(conv_id / 2) as bigint) as pair_id, conv_id % 2 = 0 as chosen, coalesce(turn, {LAST}) as turn,
                         coalesce(role, 'user') as role, coalesce(text, '') as text from conversations where conv_id is not null),
    counted as (select pair_id, turn, role, text, count(*) filter (chosen) as c, count(*) filter (not chosen) as r from rows group by all),
    cuts as (select pair_id, min(turn) as cut from counted where c <> r group by pair_id),
    placed as (select p.*, coalesce(turn < cut, true) as shared from counted p left join cuts using (pair_id)),
    segments as (select *, 'prompt' as segment from placed where shared
                 union all select *, 'chosen' from placed where not shared and c > 0 union all select *, 'rejected' from placed where not shared and r > 0),
    rendered as (select pair_id, case when turn < {LAST} then turn // {PART_TURNS} end as part, segment, turn, role, text,
                        '{START}' || role || chr(10) || text || '{END}' || chr(10) as t, length('{START}' || role) + 1 as head from segments),
    placed2 as (select *, sum(length(t)) over (partition by pair_id, part, segment order by turn, role, t rows unbounded preceding) as upto from rendered)
    select pair_id, part, coalesce(string_agg(t, '' order by turn, role, t) filter (segment = 'prompt'), '') as prompt,
           coalesce(string_agg(t, '' order by turn, role, t) filter (segment = 'chosen'), '') as chosen, coalesce(string_agg(t, '' order by turn, role, t) filter (segment = 'rejected'), '') as rejected,
           coalesce(string_agg((upto - length(t) + head) || '-' || (upto - 1), ',' order by turn, role, t) filter (segment = 'chosen' and role = 'assistant'), '') as chosen_loss,
           coalesce(string_agg((upto - length(t) + head) || '-' || (upto - 1), ',' order by turn, role, t) filter (segment = 'rejected' and role = 'assistant'), '') as rejected_loss,
           count(*) as turns from placed2 group by pair_id, part
"""
