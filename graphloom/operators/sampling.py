"""Random walks, sampling distributions and skip-gram pairs.

Draws are functions of ids, step and seed, so a plan that is run again, whole or in part,
gives the same walks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.numeric import draw, uniform
from graphloom.operators.graph import numbered
from graphloom.operators.skew import join_totals
from graphloom.plans.storage import stored

#: Steps that one job makes where each walker moves at its first draw.
STRIDE = 5


def _walkable(edges: DataFrame, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """Arcs (idx, dst, share, next) and ids (id, classes).

    Arcs are numbered by src, weight class and dst; class c holds weights above 2**(c - 1) and up to
    2**c, and ``share`` is the weight over 2**c.  ``classes`` of a node are (c, first idx, arcs), null
    where it has none, so a walker picks its arc by number, without looking at the node's others;
    ``next`` are the classes of dst.
    """
    arcs = edges.where("weight > 0") if weighted else edges.withColumn("weight", F.lit(1.0))
    arcs = arcs.select("src", "dst", "weight", F.ceil(F.log2("weight")).cast("int").alias("c"))
    held = stored(numbered(arcs, F.col("src"), F.col("c"), F.col("dst")), "arcs")
    classes = held.groupBy("src", "c").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = classes.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("c", "first", "n"))).alias("classes"))  # one for each power of two
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("met")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("met")))
    ids = stored(ends.groupBy("id").agg(F.sum("met").alias("met")).join(classes, "id", "left"), "walk-nodes")
    following = ids.select(F.col("id").alias("dst"), "met", F.col("classes").alias("next"))
    share = (F.col("weight") / F.pow(F.lit(2.0), F.col("c"))).alias("share")
    steps = join_totals(held.select("idx", "dst", share), following, ["dst"], "met", held.count())
    return stored(steps.select("idx", "dst", "share", "next"), "walk-arcs"), ids.select("id", "classes")


def _picked(classes: Column, *parts: Column | str | int) -> Column:
    """The number of an arc of a node, each with a chance in proportion to 2**c; draws are told apart by the parts."""
    mass = lambda k: k["n"] * F.pow(F.lit(2.0), k["c"])
    total = F.aggregate(classes, F.lit(0.0), lambda s, k: s + mass(k))
    aim = uniform(*parts, "c") * total
    start = F.struct(F.lit(0.0).alias("upto"), F.element_at(classes, -1).alias("k"), F.lit(False).alias("found"))
    step = lambda s, k: F.struct((s["upto"] + mass(k)).alias("upto"), F.when(~s["found"] & (aim < s["upto"] + mass(k)), k).otherwise(s["k"]).alias("k"), (s["found"] | (aim < s["upto"] + mass(k))).alias("found"))
    k = F.when(F.size(classes) == 1, classes[0]).otherwise(F.aggregate(classes, start, step)["k"])
    return k["first"] + draw(*parts, "n") % k["n"]


def _starts(ids: DataFrame, nodes: DataFrame | None, walks: int) -> DataFrame:
    """(walk, start, node, classes): each walk from each node, those without arcs too."""
    if nodes is not None:
        ids = ids.join(nodes.select("id").distinct(), "id", "full")
    return ids.select(F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.col("id").alias("start"), F.col("id").alias("node"), "classes")


def uniform_walks(edges: DataFrame, length: int, walks: int = 1, seed: int = 0, nodes: DataFrame | None = None) -> DataFrame:
    """(walk, start, step, node): walks of up to ``length`` nodes from every node of the edges and of ``nodes``, whose ids may be of any type.

    Weights are ignored; a walk ends early at a node without arcs.  A step joins each walker to
    the one arc it drew by the arc's number, so walkers at a hub are dealt over its arcs.
    """
    arcs, ids = _walkable(edges, False)
    now = _starts(ids, nodes, walks)
    out = now.select("walk", "start", F.lit(0).alias("step"), "node")
    for first in range(1, length, STRIDE):
        now = now.withColumn("path", F.array().cast(f"array<{now.schema['node'].dataType.simpleString()}>"))
        last = min(first + STRIDE, length)
        for step in range(first, last):
            # walkers at a dead end get numbers of their own, so that they aren't dealt to one task
            ended = -1 - F.pmod(F.xxhash64("start", "walk"), F.lit(1 << 40))
            aimed = now.withColumn("idx", F.coalesce(F.col("classes")[0]["first"] + draw(F.col("start"), F.col("walk"), step, 0, seed, "n") % F.col("classes")[0]["n"], ended))
            met = aimed.join(arcs.select("idx", "dst", "next"), "idx", "left")
            now = met.select("walk", "start", F.col("dst").alias("node"), F.col("next").alias("classes"), F.concat("path", F.array("dst")).alias("path"))
        now = stored(now, "walkers")
        steps = now.select("walk", "start", F.posexplode("path").alias("at", "node"))
        out = out.unionByName(steps.where("node is not null").select("walk", "start", (F.col("at") + first).alias("step"), "node"))
        now = now.where("classes is not null").drop("path")
    return out


def transitions(edges: DataFrame, p: float, q: float) -> DataFrame:
    """(prev, cur, nxt, prob): second-order steps.  weight/p back to prev, weight where the arc nxt->prev exists, else weight/q."""
    first = edges.select(F.col("src").alias("prev"), F.col("dst").alias("cur"))
    second = edges.select(F.col("src").alias("cur"), F.col("dst").alias("nxt"), "weight")
    closing = edges.select(F.col("src").alias("nxt"), F.col("dst").alias("prev"), F.lit(True).alias("near"))
    paths = first.join(second, "cur").join(closing, ["nxt", "prev"], "left")
    bias = F.when(F.col("nxt") == F.col("prev"), F.col("weight") / p).when(F.col("near"), F.col("weight")).otherwise(F.col("weight") / q)
    total = F.sum("bias").over(Window.partitionBy("prev", "cur"))
    return paths.withColumn("bias", bias).select("prev", "cur", "nxt", (F.col("bias") / total).alias("prob"))


def biased_walks(edges: DataFrame, length: int, p: float, q: float, seed: int = 0, walks: int = 1, nodes: DataFrame | None = None) -> DataFrame:
    """(walk, start, step, node): the first step by weight, later ones with the chances of ``transitions``.

    Walkers propose arcs in proportion to 2**c of their weight class and accept one with the chance
    share * bias / largest bias; the first accepted try counts, and walkers try until all have one.
    So a step touches as many arcs as there are tries, not all pairs of arcs that meet in a node.
    """
    arcs, ids = _walkable(edges, True)
    closing = edges.select(F.col("src").alias("dst"), F.col("dst").alias("prev"), F.lit(True).alias("near"))
    now = stored(_starts(ids, nodes, walks), "walkers")
    out = now.select("walk", "start", F.lit(0).alias("step"), "node")
    for step in range(1, length):
        pending, moved, lo, hi = now.where("classes is not null"), None, 0, 8
        while not pending.isEmpty():
            tries = pending.withColumn("try", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
            key = (F.col("start"), F.col("walk"), step, F.col("try"), seed)
            met = tries.withColumn("idx", _picked(F.col("classes"), *key)).drop("classes").join(arcs, "idx")
            chance = F.col("share")
            if step > 1:
                bias = F.when(F.col("dst") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
                met, chance = met.join(closing, ["dst", "prev"], "left"), chance * bias / max(1 / p, 1.0, 1 / q)
            taken = met.where(uniform(*key, "a") < chance).groupBy("walk", "start").agg(F.min_by(F.struct(F.col("node").alias("prev"), F.col("dst").alias("node"), F.col("next").alias("classes")), "try").alias("m"))
            taken = stored(taken.select("walk", "start", "m.*"), "moved")
            moved = taken if moved is None else moved.unionByName(taken)
            pending = stored(pending.join(taken.select("walk", "start"), ["walk", "start"], "left_anti"), "pending")
            lo, hi = hi, 3 * hi
        if moved is None:
            break
        now = moved
        out = out.unionByName(now.select("walk", "start", F.lit(step).alias("step"), "node"))
    return out


def paths(walks: DataFrame, *keys: str) -> DataFrame:
    """One row for each walk with its nodes in order."""
    steps = F.array_sort(F.collect_list(F.struct("step", "node")))
    return walks.groupBy(*keys).agg(steps.alias("_s")).select(*keys, F.col("_s.node").alias("path"))


def skipgram_pairs(walks: DataFrame, keys: list[str], window: int) -> DataFrame:
    """(center, context, n): pairs at most ``window`` steps apart.  Each step is joined to its 2 * window neighbours by equality."""
    around = walks.withColumn("at", F.explode(F.array(*[F.col("step") + d for d in range(-window, window + 1) if d])))
    other = walks.select(*keys, F.col("step").alias("at"), F.col("node").alias("context"))
    return around.join(other, [*keys, "at"]).groupBy(F.col("node").alias("center"), "context").agg(F.count(F.lit(1)).alias("n"))


def noise(edges: DataFrame, exponent: float = 0.75) -> DataFrame:
    """(id, prob): out-strength to the power ``exponent``, normalised."""
    strength = edges.groupBy(F.col("src").alias("id")).agg(F.pow(F.sum("weight"), F.lit(exponent)).alias("s"))
    total = strength.agg(F.sum("s").alias("total"))
    return strength.crossJoin(F.broadcast(total)).select("id", (F.col("s") / F.col("total")).alias("prob"))


def edge_shares(edges: DataFrame) -> DataFrame:
    total = edges.agg(F.sum("weight").alias("total"))
    return edges.crossJoin(F.broadcast(total)).select("src", "dst", (F.col("weight") / F.col("total")).alias("prob"))


def alias_table(probs: list[float]) -> tuple[list[int], list[float]]:
    """Vose's alias table of a distribution: column k yields k with chance q[k], else j[k]."""
    n = len(probs)
    scaled = [p * n for p in probs]
    j, q = list(range(n)), [1.0] * n
    small = [k for k, x in enumerate(scaled) if x < 1]
    large = [k for k, x in enumerate(scaled) if x >= 1]
    while small and large:
        low, high = small.pop(), large[-1]
        q[low], j[low] = scaled[low], high
        scaled[high] -= 1 - scaled[low]
        if scaled[high] < 1:
            small.append(large.pop())
    return j, q


def alias_tables(shares: DataFrame, key: str, value: str, prob: str) -> DataFrame:
    """(key, vals, j, q): an alias table for each key, for keys whose outcomes fit into a row."""
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in shares.schema}

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value)
        j, q = alias_table(pdf[prob].tolist())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "vals": [pdf[value].tolist()], "j": [j], "q": [q]})

    return shares.select(key, value, prob).groupBy(key).applyInPandas(build, f"{key} {kinds[key]}, vals array<{kinds[value]}>, j array<int>, q array<double>")


def alias_draw(tables: DataFrame, rows: DataFrame, key: str, *parts: Column | str | int) -> DataFrame:
    """``rows`` with ``drawn``, a value of their key's alias table in two draws, which ``parts`` tell apart; rows of unknown keys go."""
    column = (draw(*parts, "n") % F.size("vals")).cast("int")
    value = F.when(uniform(*parts, "a") < F.col("q")[column], F.col("vals")[column]).otherwise(F.col("vals")[F.col("j")[column]])
    return rows.join(tables, key).withColumn("drawn", value).drop("vals", "j", "q")
