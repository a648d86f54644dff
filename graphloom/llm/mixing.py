"""Mixing sources to target weights, with DataFrame operations only.

Sizes are summed for each source, targets found by filling sources up to their caps, and each
document is then emitted floor(rate) times plus once more with probability rate - floor(rate),
drawn from a hash of its id.  The hash is rotated by a constant for each source: of ``ROTATIONS``
constants the one whose total comes nearest the target, found in one partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import workspace
from graphloom.operators.graph import numbered
from graphloom.operators.skew import join_totals

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SPACE = 1 << 32
ROTATIONS = 16


def draw(doc_id: Column) -> Column:
    """A number below 2**32 from the md5 of the id; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def key(source: Column) -> Column:
    """The source as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """The columns of ``sizes`` (source, source_size, ...; one row for each source), weight and target.

    The share is given out by weight; a source stops at ``cap`` times its size and what it can't
    take goes to the others by weight until none is above.  That end point is a common level
    times the weight, cut at the cap.  The level only rises from round to round, as more sources
    reach their caps; each round is one partial aggregation over the sources.
    """
    numbered_ = numbered(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    book = workspace.keep(numbered_.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap))).drop("idx"), "mix-weights")
    total = float(book.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level = 0.0
    while True:
        full = F.col("_cap") < F.col("weight") * level
        row = book.agg(F.sum(F.when(full, F.col("_cap"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            target = F.col("_cap")
            break
        risen = (total - (row["taken"] or 0.0)) / row["open"]
        target = F.least("_cap", F.col("weight") * F.lit(risen))
        if risen <= level:
            break
        level = risen
    return book.withColumn("target", target).drop("_cap")


def _copied(turn: Column) -> Column:
    """The drawn copy of a document, 0 or 1, with the draw rotated by ``turn``."""
    return F.when((F.col("_draw") + turn * (SPACE // ROTATIONS)) % SPACE < F.col("_part"), 1).otherwise(0)


def rates(sized: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """_key, _rows, source_size, target, _whole, _part, _turn of each source, for rows (_key, source, size, _draw); a stored table."""
    sizes = workspace.keep(sized.groupBy("_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), "mix-sources")
    goal = targets(sizes, share, cap, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("_whole", F.floor(rate).cast("long")).withColumn("_part", F.floor((rate - F.floor(rate)) * SPACE).cast("long"))
    goal = workspace.keep(goal.select("_key", "_rows", "source_size", "target", "_whole", "_part"), "mix-goal")
    sums = join_totals(sized.select("_key", "size", "_draw"), goal, ["_key"], "_rows", sized.count()).groupBy("_key").agg(
        *[F.sum(F.col("size") * (F.col("_whole") + _copied(F.lit(k).cast("long")))).alias(f"t{k}") for k in range(ROTATIONS)]
    )
    misses = F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("miss"), F.lit(k).alias("turn")) for k in range(ROTATIONS)])
    best = sums.join(goal, "_key").select(*goal.columns, F.array_min(misses)["turn"].cast("long").alias("_turn"))
    return workspace.keep(best, "mix-rates")


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return workspace.keep(docs.select("doc_id", "source", size.alias("size")), "mix-sizes").select("*", key(F.col("source")).alias("_key"), draw(F.col("doc_id")).alias("_draw"))


def mix(
    docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, a row for each document.

    size: runs of characters other than space and 0x09-0x0D, 0 for null.  A null source is a source
    of its own, the last.  Rows of the same id share their draw; sizes of 0 take 0; an empty table
    gives no rows.  ``copies`` never exceeds ``cap`` rounded up; clashing extra columns are ignored.
    """
    sized = _sized(docs)
    found = join_totals(sized, rates(sized, share, cap, weights), ["_key"], "_rows", sized.count())
    copies = (F.col("_whole") + _copied(F.col("_turn"))).cast("long")
    return found.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def emit(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as ``mix`` takes it.

    How often is computed beside each row from its id and its source's rate, so texts stay in their
    tasks unless the sources are too many to broadcast.
    """
    sized = _sized(docs)
    book = rates(sized, share, cap, weights).select("_key", "_rows", "_whole", "_part", "_turn")
    keyed = docs.select("*", key(F.col("source")).alias("_key"), draw(F.col("doc_id")).alias("_draw"))
    copies = (F.col("_whole") + _copied(F.col("_turn"))).cast("int")
    found = join_totals(keyed, book, ["_key"], "_rows", sized.count()).select(*docs.columns, copies.alias("_copies")).where("_copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def oracle(share: float = 1.5, cap: float = 2.0) -> str:
    """The same in DuckDB's SQL."""
    turns = ", ".join(f"({k})" for k in range(ROTATIONS))
    word = WORD.replace("\\x0D", "\\x0D")
    return rf"""
    with sized as (
        select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{word}')), 0) as bigint) as size,
               cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) as draw
        from documents),
    s as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
    w as (select *, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as weight,
                 cast(source_size as double) * {float(cap)} as cap, cast(sum(source_size) over () as double) * {float(share)} as total from s),
    l as (select *, cap / weight as level from w),
    t as (select *, (total - coalesce(sum(cap) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0))
                    / sum(weight) over (order by level, source nulls last rows between current row and unbounded following) as try from l),
    c as (select *, max(case when try <= level then try end) over () as common from t),
    g as (select source, source_size, least(cap, coalesce(common * weight, cap)) as target from c),
    r as (select *, case when source_size > 0 then target / source_size else 0.0 end as rate from g),
    p as (select *, cast(floor(rate) as bigint) as whole, cast(floor((rate - floor(rate)) * {SPACE}) as bigint) as part from r),
    turns(turn) as (values {turns}),
    tried as (select p.source, turn, abs(sum(size * (whole + case when (draw + cast(turn as bigint) * {SPACE // ROTATIONS}) % {SPACE} < part then 1 else 0 end)) - any_value(target)) as miss
              from sized join p on sized.source is not distinct from p.source cross join turns group by p.source, turn),
    best as (select source, turn from (select *, row_number() over (partition by source order by miss, turn) as k from tried) where k = 1),
    j as (select sized.*, p.source_size, p.target, whole + case when (draw + cast(turn as bigint) * {SPACE // ROTATIONS}) % {SPACE} < part then 1 else 0 end as copies
          from sized join p on sized.source is not distinct from p.source join best on best.source is not distinct from p.source)
    select doc_id, size, source_size, target, cast(size * copies as bigint) as taken from j
    """
