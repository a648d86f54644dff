"""Components, spanning forests, communities and edge splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.numeric import BITS, draw
from graphloom.operators import skew
from graphloom.operators.graph import canonical, numbered
from graphloom.plans.storage import stored

#: Communities of graphs of at most this many bytes, as counted by ``skew.size``, are found in one process.
LOCAL_BYTES = 64 << 20
#: Of a node's strength: a move that gains less is none, for sums are rounded.
LEAST_GAIN = 1e-12
#: Edges of a task that finds a forest of its own.
FOREST_EDGES = 250_000
#: More rows than ``FEW`` are chosen by counts of this many ranges of their draws, not sorted by one task.
FEW, RANGES_BITS = 10_000, 12


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component) for every node of the edges and of ``nodes``; component is its least node."""
    found = skew.components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).select(F.col("node").alias("id"), F.col("root").alias("component"))
    if nodes is None:
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges within the largest component; of equally large ones that of the least node."""
    parts = stored(connected_components(edges), "components")
    best = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = parts.join(F.broadcast(best), "component").select(F.col("id").alias("src"))
    return edges.join(inside, "src", "left_semi")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, weight): the minimum spanning forest by Boruvka's rounds, ties broken by (u, v), which makes it unique.

    An edge that is in no forest of some part of the edges isn't in that of all.  So tasks first drop such
    edges of their own parts, again and again while that halves them; what one task can hold ends there.
    """
    pool = stored(canonical(edges).where("u is not null and v is not null"), "pool")
    count = pool.count()
    while True:
        tasks = max(1, -(-count // FOREST_EDGES))
        parts = pool.coalesce(1) if tasks == 1 else pool.repartition(tasks)
        pool = stored(parts.mapInArrow(skew.forest_of, pool.schema), "thinned")
        if tasks == 1:
            return pool
        before, count = count, pool.count()
        if 2 * count > before:
            break
    chosen: DataFrame | None = None
    label = stored(pool.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.col("id").alias("c")), "labels")
    while True:
        tagged = pool.join(label.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(label.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").where("cu <> cv")
        pool = stored(tagged, "pool")
        if pool.isEmpty():
            break
        edge = F.struct("weight", "u", "v")
        sides = pool.select(F.col("cu").alias("c"), edge.alias("e")).unionByName(pool.select(F.col("cv").alias("c"), edge.alias("e")))
        best = stored(sides.groupBy("c").agg(F.min("e").alias("e")).select("e.u", "e.v", "e.weight").distinct(), "best")
        chosen = best if chosen is None else chosen.unionByName(best)
        merged = best.join(label.select(F.col("id").alias("u"), F.col("c").alias("src")), "u").join(label.select(F.col("id").alias("v"), F.col("c").alias("dst")), "v")
        joined = connected_components(merged.select("src", "dst"))
        label = stored(label.join(joined.select(F.col("id").alias("c"), "component"), "c", "left").select("id", F.coalesce("component", "c").alias("c")), "labels")
        pool = pool.select("u", "v", "weight")
    return pool.select("u", "v", "weight") if chosen is None else stored(chosen, "forest")


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(q): Newman's modularity of ``parts`` (id, part) for symmetric edges."""
    tagged = edges.join(parts.select(F.col("id").alias("src"), F.col("part").alias("ps")), "src").join(parts.select(F.col("id").alias("dst"), F.col("part").alias("pd")), "dst")
    total = tagged.agg(F.sum("weight").alias("m2"))
    inner = tagged.groupBy(F.col("ps").alias("part")).agg(F.sum(F.when(F.col("ps") == F.col("pd"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("strength"))
    term = F.col("inside") / F.col("m2") - F.col("strength") * F.col("strength") / (F.col("m2") * F.col("m2"))
    return inner.crossJoin(F.broadcast(total)).agg(F.sum(term).alias("q"))


def louvain(edges: DataFrame, seed: int = 23, patience: int = 4) -> DataFrame:
    """(id, part): communities by local moves of greatest modularity gain, level by level, until nothing gains.

    In a round half of the communities, drawn by a hash, may gain members from the others, so that
    two nodes never swap places.  Of the moves into one community and out of one, in the order of their
    gains, those are made that still gain after all before them; so each round with moves raises the
    modularity.  A level ends when no node has a move that gains, whatever the halves; the search ends
    with a level that merges nothing.  Arcs that are not the same both ways, or of negative weight,
    promise no such rise: then a level also ends after ``patience`` rounds without one, with the best
    partition seen.  A graph of at most ``LOCAL_BYTES`` takes the same steps with the same draws in one process.
    """
    graph = stored(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "louvain")
    kinds = {graph.schema[c].dataType.typeName() for c in ("src", "dst")}
    if len(kinds) == 1 and kinds <= {"string", "long", "integer"} and graph.where("src is null or dst is null or weight is null").isEmpty() and skew.size(graph) <= LOCAL_BYTES:
        return _louvain_local(graph, seed, patience)
    m2 = graph.agg(F.sum("weight")).first()[0] or 1.0
    rises = graph.where("weight < 0").isEmpty() and graph.exceptAll(graph.select("dst", "src", "weight")).isEmpty()
    whole = stored(graph.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("part")), "parts")
    turn = 0
    while True:
        strength = stored(graph.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")), "strength")
        parts = best = strength.select("id", F.col("id").alias("part"), "k")
        top, since, moved = None, 0, False
        least = LEAST_GAIN * F.abs("k")
        while True:
            turn += 1
            sizes = parts.groupBy("part").agg(F.sum("k").alias("s"))
            near = graph.join(parts.select(F.col("id").alias("dst"), F.col("part").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum(F.when(F.col("src") != F.col("dst"), F.col("weight")).otherwise(0.0)).alias("w"), F.sum("weight").alias("all"))
            joined = near.join(parts, "id").join(sizes.select(F.col("part").alias("to"), F.col("s").alias("st")), "to")
            own = F.when(F.col("to") == F.col("part"), F.col("k")).otherwise(0.0)
            gain = F.col("w") - F.col("k") * (F.col("st") - own) / m2
            # a node without links into its own community gains by leaving it
            stay = F.max(F.when(F.col("to") == F.col("part"), gain)).over(Window.partitionBy("id"))
            left = sizes.select("part", F.col("s").alias("sp"))
            alone = F.coalesce(F.col("stay"), -F.col("k") * (F.col("sp") - F.col("k")) / m2)
            options = joined.withColumn("gain", gain).withColumn("stay", stay).join(left, "part")
            options = options.withColumn("more", F.col("gain") - alone)
            options = stored(options.withColumn("gains", (F.col("to") != F.col("part")) & (F.col("more") > least)), "options")
            squares = sizes.agg(F.sum(F.col("s") * F.col("s")).alias("q"))
            found = options.agg(F.sum(F.when(F.col("to") == F.col("part"), F.col("all"))).alias("within"), F.count(F.when(F.col("gains"), 1)).alias("gaining")).crossJoin(F.broadcast(squares)).first()
            quality = (found["within"] or 0.0) / m2 - (found["q"] or 0.0) / (m2 * m2)
            if rises or top is None or quality > top + 1e-10:
                top, best, since = quality, parts, 0
            else:
                since += 1
            if since >= patience or not found["gaining"]:
                break
            open_ = F.pmod(F.xxhash64("to", F.lit(seed + turn)), F.lit(2)) == 0
            closed = F.pmod(F.xxhash64("part", F.lit(seed + turn)), F.lit(2)) == 1
            wanted = options.where(F.col("gains") & open_ & closed).groupBy("id").agg(F.max(F.struct("gain", "to", "more", "k", "part")).alias("b")).select("id", "b.*")
            sooner = lambda c: F.coalesce(F.sum("k").over(Window.partitionBy(c).orderBy(F.desc("more"), "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            wanted = wanted.withColumn("before", sooner("to")).withColumn("before", F.col("before") + sooner("part"))
            next_ = wanted.where(F.col("more") > least + F.col("k") * F.col("before") / m2).select("id", F.col("to").alias("next"))
            parts = stored(parts.join(next_, "id", "left").select("id", F.coalesce("next", "part").alias("part"), "k"), "parts")
            moved = True
        whole = stored(whole.join(best.select(F.col("id").alias("part"), F.col("part").alias("next")), "part", "left").select("id", F.coalesce("next", "part").alias("part")), "parts")
        if not moved or best.where("id <> part").isEmpty():
            return whole
        a, b = best.select(F.col("id").alias("src"), F.col("part").alias("_s")), best.select(F.col("id").alias("dst"), F.col("part").alias("_d"))
        graph = stored(graph.join(a, "src").join(b, "dst").groupBy(F.col("_s").alias("src"), F.col("_d").alias("dst")).agg(F.sum("weight").alias("weight")), "louvain")


def _odd(hashes: np.ndarray, number: int) -> np.ndarray:
    """Whether Spark's xxhash64 of a value and an int is odd, from the hashes of the values alone."""
    big = np.uint64
    p1, p2, p3, p5 = map(big, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (hashes.view(np.uint64) + p5 + big(4)) ^ (np.full(1, number, np.uint64) * p1)
    h = ((h << big(23)) | (h >> big(41))) * p2 + p3
    h = (h ^ (h >> big(33))) * p2
    h = (h ^ (h >> big(29))) * p3
    return ((h ^ (h >> big(32))) & big(1)).astype(bool)


def _sums(keys: list[np.ndarray], *values: np.ndarray) -> list[np.ndarray]:
    """The distinct (a, b) of two arrays of keys, sorted, and the sums of each of ``values``."""
    if not len(keys[0]):
        return [*keys, *values]
    order = np.lexsort(keys[::-1])
    a, b = (k[order] for k in keys)
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return [a[first], b[first], *[np.add.reduceat(v[order], first) for v in values]]


def _earlier(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each place the sum of the values at earlier places of the same key."""
    order = np.argsort(keys, kind="stable")
    sums = np.cumsum(values[order]) - values[order]
    first = np.searchsorted(keys[order], keys[order])
    found = np.empty(len(keys))
    found[order] = sums - sums[first]
    return found


def _louvain_local(graph: DataFrame, seed: int, patience: int) -> DataFrame:
    """``louvain`` of summed arcs without nulls; places in the sorted ids stand for nodes and communities."""
    spark = graph.sparkSession
    nodes = graph.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.xxhash64("id").alias("h")).toArrow().sort_by("id")
    ids, hashes = nodes["id"].combine_chunks(), nodes["h"].to_numpy().astype(np.int64)
    arcs = graph.toArrow()
    src, dst = (pc.index_in(arcs[c], value_set=ids).to_numpy().astype(np.int64) for c in ("src", "dst"))
    whole = _communities(src, dst, arcs["weight"].cast(pa.float64()).to_numpy(), hashes, seed, patience)
    return spark.createDataFrame(pa.table({"id": ids, "part": ids.take(pa.array(whole))}))


def _communities(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, hashes: np.ndarray, seed: int, patience: int) -> np.ndarray:
    """The community of each of the nodes, one for each of ``hashes``.

    A row (arc's source, community) of links stands at the place of one of the source's arcs.  After
    a round only rows of nodes near those that moved are summed again, and only gains from or
    into communities that changed are found again.
    """
    n, m2, turn = len(hashes), weight.sum() or 1.0, 0
    whole = np.arange(n)
    src, dst, weight = _sums([src, dst], weight)
    back = np.lexsort((src, dst))
    rises = not (weight < 0).any() and all(np.array_equal(x, y[back]) for x, y in ((src, dst), (dst, src), (weight, weight)))
    while True:
        here = np.zeros(n, bool)
        here[src] = True  # nodes without arcs of their own take no part
        k = np.bincount(src, weight, n)
        parts = best = np.where(here, np.arange(n), -1)
        inside = here[dst]
        a, b, w, plain = src[inside], dst[inside], weight[inside], np.where(src == dst, 0.0, weight)[inside]
        start, least = np.searchsorted(a, np.arange(n)), LEAST_GAIN * np.abs(k)
        to, near, all_ = np.full(len(a), -1), np.zeros(len(a)), np.zeros(len(a))
        more, gain, gains, stay = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a), bool), np.zeros(n)
        touched, changed = here, np.append(np.ones(n, bool), False)  # the last stands for rows not in use
        top, since, moved = None, 0, False
        while True:
            turn += 1
            sizes = np.bincount(parts[here], k[here], n)
            again = np.flatnonzero(touched[a])
            to[again], gains[again] = -1, False
            id_, *row = _sums([a[again], parts[b[again]]], plain[again], w[again])
            place = start[id_] + np.arange(len(id_)) - np.searchsorted(id_, id_)
            to[place], near[place], all_[place] = row
            fresh = touched | changed[parts]
            rows = np.flatnonzero((fresh[a] | changed[to]) & (to >= 0))
            id_, into = a[rows], to[rows]
            own = into == parts[id_]
            gain[rows] = near[rows] - k[id_] * (sizes[into] - np.where(own, k[id_], 0.0)) / m2
            # a node without links into its own community gains by leaving it
            stay[fresh] = (-k * (sizes[parts] - k) / m2)[fresh]
            stay[id_[own]] = gain[rows[own]]
            more[rows] = gain[rows] - stay[id_]
            gains[rows] = ~own & (more[rows] > least[id_])
            if rises:
                best = parts
            else:
                quality = all_[to == parts[a]].sum() / m2 - (sizes * sizes).sum() / (m2 * m2)
                if top is None or quality > top + 1e-10:
                    top, best, since = quality, parts, 0
                else:
                    since += 1
            found = np.flatnonzero(gains)
            if since >= patience or not len(found):
                break
            odd = _odd(hashes, seed + turn)
            found = found[~odd[to[found]] & odd[parts[a[found]]]]
            found = found[np.lexsort((to[found], gain[found], a[found]))]
            found = found[np.append(a[found[1:]] != a[found[:-1]], True)[: len(found)]]  # of one node the last, its greatest gain
            found = found[np.lexsort((a[found], -more[found]))]
            id_, into = a[found], to[found]
            made = more[found] > least[id_] + k[id_] * (_earlier(into, k[id_]) + _earlier(parts[id_], k[id_])) / m2
            id_, into = id_[made], into[made]
            touched, changed = np.zeros(n, bool), np.zeros(n + 1, bool)
            changed[parts[id_]] = changed[into] = True
            parts = parts.copy()
            parts[id_] = into
            gone = np.zeros(n, bool)
            gone[id_] = True
            touched[a[gone[b]]] = True
            moved = True
        there = here[whole]
        whole = np.where(there, best[whole], whole)
        if not moved or (best[here] == np.flatnonzero(here)).all():
            return whole
        src, dst, weight = _sums([best[a], best[b]], w)


def without_edges(edges: DataFrame, others: DataFrame) -> DataFrame:
    """Undirected edges (u, v) that are not in ``others``; orientation doesn't matter."""
    flat = others.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return edges.withColumns({"u": F.least("u", "v"), "v": F.greatest("u", "v")}).join(flat, ["u", "v"], "left_anti")


def least_drawn(rows: DataFrame, order: Column, ties: list[str], k: int) -> DataFrame:
    """The k rows of least (order, ties), where ``order`` is a draw: at most ``FEW`` by a sort, more by the range of draws that holds the last of them."""
    if k <= FEW:
        return rows.orderBy(order, *ties).limit(k)
    held = stored(rows.withColumn("_draw", order), "drawn")
    span = F.shiftright("_draw", BITS - RANGES_BITS)
    before = 0
    for row in held.groupBy(span.alias("r")).count().orderBy("r").collect():
        if before + row["count"] >= k:
            last = held.where(span == row["r"]).orderBy("_draw", *ties).limit(k - before)
            return held.where(span < row["r"]).unionByName(last).drop("_draw")
        before += row["count"]
    return held.drop("_draw")


def sampled(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k edges, uniform by a hash of their ends, which may be of any type."""
    return least_drawn(edges, draw(F.col("u"), F.col("v"), seed), ["u", "v"], k)


def non_edges(edges: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(u, v): ``count`` distinct pairs u < v of the edges' nodes without an edge, uniform by hash; all of them if there are fewer.

    Pairs are numbered 0..n(n-1)/2-1.  Where most are free, numbers are drawn until enough are; no
    table of all pairs is made.  Where over half are taken or asked for, all pairs are enumerated,
    then at most about twice as many as there are edges and asked-for pairs.
    """
    book = stored(numbered(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct(), F.col("id")), "nodes")
    spark, n = edges.sparkSession, book.count()
    low, high = book.select(F.col("idx").alias("a"), F.col("id").alias("u")), book.select(F.col("idx").alias("b"), F.col("id").alias("v"))
    flat = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    # the pair a < b has the number b(b-1)/2 + a
    known = stored(flat.join(low, "u").join(high, "v").select((F.col("b") * (F.col("b") - 1) / 2).cast("long").alias("t"), "a").select((F.col("t") + F.col("a")).alias("pair")), "known-pairs")
    every = n * (n - 1) // 2
    free = every - known.count()
    want = min(count, free)
    order = draw(F.col("pair"), seed)
    if 2 * (want + every - free) >= every:
        found = spark.range(every).select(F.col("id").alias("pair")).join(known, "pair", "left_anti")
    else:
        tries = 64 + 2 * want
        while True:  # under half of all pairs are taken or wanted, so each round is likely to do
            found = spark.range(tries).select((draw(F.col("id"), seed, "pair") % every).alias("pair")).distinct().join(known, "pair", "left_anti")
            found = stored(found, "free-pairs")
            if found.count() >= want:
                break
            tries *= 2
    chosen = stored(least_drawn(found, order, ["pair"], want), "non-edges")
    b = F.floor((F.sqrt(8.0 * F.col("pair") + 1) + 1) / 2).cast("long")
    fits = lambda x: (x * (x - 1) / 2).cast("long")
    b = F.when(fits(b) > F.col("pair"), b - 1).when(fits(b + 1) <= F.col("pair"), b + 1).otherwise(b)  # the root is rounded
    ends = chosen.select("pair", b.alias("b")).select("b", (F.col("pair") - fits(F.col("b"))).alias("a"))
    return ends.join(low, "a").join(high, "b").select("u", "v")


def train_test(edges: DataFrame, train_ratio: float = 0.8, negatives: int = 5, seed: int = 42) -> DataFrame:
    """(u, v, label, part): a spanning forest and hash-chosen edges train, the rest test; ``negatives`` non-edges for each edge of each part.

    Where the graph has too few non-edges they are dealt to the parts in the ratio of the edges.
    """
    base = stored(canonical(edges), "edges")
    tree = spanning_forest(base.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight")).select("u", "v")
    total = base.count()
    rest = stored(without_edges(base.select("u", "v"), tree), "rest")
    more = max(0, round(train_ratio * total) - tree.count())
    extra = stored(sampled(rest, more, seed), "extra")
    test = without_edges(rest, extra)
    positive = tree.unionByName(extra).withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    none = stored(non_edges(base, negatives * total, seed), "negatives")
    trained = total - max(0, rest.count() - more)
    share = round(none.count() * trained / total) if total else 0
    first = stored(least_drawn(none, draw(F.col("u"), F.col("v"), seed, "part"), ["u", "v"], share), "negatives-train")
    marked = first.withColumn("part", F.lit("train")).unionByName(none.join(first, ["u", "v"], "left_anti").withColumn("part", F.lit("test")))
    return positive.select("u", "v", F.lit(1).alias("label"), "part").unionByName(marked.select("u", "v", F.lit(0).alias("label"), "part"))
