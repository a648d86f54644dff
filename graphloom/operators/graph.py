"""The property graph and its relational operators.

A graph is two DataFrames that are never collected: ``nodes`` (id and any attributes) and
``edges`` (src, dst, weight), always directed.  An undirected graph holds both arcs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(edges: DataFrame, order: str = "line_no") -> DataFrame:
    """One arc for each (src, dst): the weight that comes last in ``order``."""
    return edges.groupBy("src", "dst").agg(F.max_by("weight", order).alias("weight"))


def reversed_arcs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def symmetrized(edges: DataFrame, order: str | None = None) -> DataFrame:
    """Both arcs of each edge.  With ``order`` the last weight wins over both directions, else the largest."""
    both = edges.unionByName(reversed_arcs(edges))
    if order:
        return last_wins(both, order)
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges once, as (least, greatest), without loops; the largest weight stays."""
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "weight")
    return pair.groupBy("u", "v").agg(F.max("weight").alias("weight"))


def first_appearance(edges: DataFrame, order: str = "line_no") -> DataFrame:
    """(id, idx): nodes numbered from 0 in the order in which they first appear, src before dst.

    The global number comes from a range partitioning and the counts of the ranges, so no task
    holds all nodes.
    """
    seen = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.struct(F.col(order), F.lit(0))), F.struct(F.col("dst").alias("id"), F.struct(F.col(order), F.lit(1))))).alias("s"))
    firsts = seen.groupBy("s.id").agg(F.min("s.col2").alias("at"))
    return numbered(firsts, F.col("at"), F.col("id")).select("id", "idx")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``idx`` from 0 in the given order: local numbers plus the sizes of the ranges before."""
    from graphloom.plans.storage import stored

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = stored(ranged, "numbered").withColumn("_part", F.shiftright("_at", 33)).withColumn("_local", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # one row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return held.join(F.broadcast(base), "_part").withColumn("idx", (F.col("_base") + F.col("_local")).cast("long")).drop("_part", "_at", "_local", "_base")


def sums_before(rows: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    """``rows`` with ``before_c`` for each column c: its sum over the rows before, in the given order.

    Ranges of the order are summed each in a task of its own, then moved by the totals of the ranges before.
    """
    from graphloom.plans.storage import stored

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    held = stored(ranged, "ranges").withColumn("_part", F.shiftright("_at", 33))
    inner = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns])  # one row for each range
    base = sizes.select("_part", *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"_base_{c}") for c in columns])
    told = held.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_in_{c}") for c in columns]).join(F.broadcast(base), "_part")
    return told.select(*rows.columns, *[(F.col(f"_base_{c}") + F.col(f"_in_{c}")).alias(f"before_{c}") for c in columns])


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, nbrs): sorted out-neighbours."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, degree, weighted): out-degrees; nodes without arcs get 0 where ``nodes`` is given."""
    found = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted"))
    if nodes is None:
        return found
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted", F.lit(0.0)).alias("weighted"))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None) -> PropertyGraph:
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1.0))
        return cls(ends(edges) if nodes is None else nodes, edges)

    def encoded(self) -> PropertyGraph:
        """Ids replaced by dense numbers in the order of ids; nodes keep their id next to ``idx``."""
        book = numbered(self.nodes, F.col("id"))
        index = book.select("id", "idx")
        edges = self.edges.join(index.select(F.col("id").alias("src"), F.col("idx").alias("_s")), "src").join(index.select(F.col("id").alias("dst"), F.col("idx").alias("_d")), "dst")
        return PropertyGraph(book, edges.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "weight"))

    def undirected(self) -> PropertyGraph:
        return replace(self, edges=symmetrized(self.edges))

    def attach(self, values: DataFrame, name: str) -> PropertyGraph:
        """Nodes with the column ``name`` of ``values`` (id, name); an unknown id is an error when the plan runs."""
        known = self.nodes.withColumn("_known", F.lit(True))
        joined = values.select("id", name).join(known.select("id", "_known"), "id", "left")
        checked = joined.select(F.when(F.col("_known"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("unknown node: "), F.col("id").cast("string")))).alias("id"), name)
        return replace(self, nodes=self.nodes.drop(name).join(checked, "id", "left"))

    def degrees(self) -> DataFrame:
        return degrees(self.edges, self.nodes)

    def summary(self) -> DataFrame:
        """nodes, edges, loops, is_undirected: one row."""
        back = reversed_arcs(self.edges).select("src", "dst").distinct()
        single = self.edges.join(back, ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("single"))
        arcs = self.edges.agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"))
        count = self.nodes.agg(F.count(F.lit(1)).alias("nodes"))
        return count.crossJoin(arcs).crossJoin(single).select("nodes", "edges", "loops", (F.col("single") == 0).alias("is_undirected"))
