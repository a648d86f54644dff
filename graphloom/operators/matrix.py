"""Sparse matrices as tables (i, j, v) of their non-zeros: products are joins, normalisations aggregates.

No step makes a dense matrix; a product has as many partial rows as there are two-step paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.storage import stored


def matrix(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").cast("double").alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def combined(*terms: tuple[float, DataFrame]) -> DataFrame:
    """The sum of scaled matrices."""
    rows = None
    for scale, a in terms:
        part = a.select("i", "j", (F.col("v") * F.lit(float(scale))).alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("i", "j").agg(F.sum("v").alias("v"))


def identity(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def column_stochastic(a: DataFrame) -> DataFrame:
    """v over the sum of its column."""
    return a.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("j")))


def row_l1(a: DataFrame) -> DataFrame:
    """v over the sum of absolute values of its row; zero rows have no entries and stay zero."""
    total = F.sum(F.abs("v")).over(Window.partitionBy("i"))
    return a.withColumn("v", F.coalesce(F.try_divide(F.col("v"), total), F.lit(0.0)))


def symmetric_normalised(a: DataFrame) -> DataFrame:
    """(A D^-1/2)' D^-1/2 with D the row sums; directed input comes out transposed, zero degrees drop out."""
    degree = a.groupBy("i").agg(F.sum("v").alias("d"))
    both = a.join(degree.withColumnRenamed("d", "di"), "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    return both.where("di > 0 and dj > 0").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") / F.sqrt("di") / F.sqrt("dj")).alias("v"))


def renormalised(a: DataFrame, nodes: DataFrame) -> DataFrame:
    """The symmetric normalisation of A + I; a loop's weight grows by 1."""
    return symmetric_normalised(combined((1, a), (1, identity(nodes))))


def laplacian(a: DataFrame, nodes: DataFrame) -> DataFrame:
    """D^-1/2 (D - A) D^-1/2 over nodes of positive degree."""
    linked = a.groupBy("i").agg(F.sum("v").alias("d")).where("d > 0").select(F.col("i").alias("id"))
    return combined((1, identity(linked)), (-1, transposed(symmetric_normalised(a))))


def power(p: DataFrame, k: int) -> DataFrame:
    out = p
    for step in range(1, k):
        out = product(out, p)
        if step % 3 == 0:
            out = stored(out, "power")
    return out


def positive_log(a: DataFrame, n: DataFrame) -> DataFrame:
    """max(0, ln(v / column sum) - ln(1 / nodes)), zeros left out; ``n`` is the one-row count of nodes."""
    share = F.col("v") / F.sum("v").over(Window.partitionBy("j"))
    return a.where("v > 0").withColumn("v", share).crossJoin(F.broadcast(n.select(F.col("n").cast("double").alias("_n")))).select("i", "j", F.ln(F.col("v") * F.col("_n")).alias("v")).where("v > 0")


def tadw_target(p: DataFrame) -> DataFrame:
    return combined((0.5, p), (0.5, product(p, p)))


def chebyshev(scaled: DataFrame, nodes: DataFrame, order: int) -> list[DataFrame]:
    """T_0..T_order of a matrix scaled to [-1, 1]."""
    terms = [identity(nodes), scaled]
    for _ in range(2, order + 1):
        terms.append(combined((2, product(scaled, terms[-1])), (-1, terms[-2])))
    return terms[: order + 1]


def scaled_laplacian(a: DataFrame, nodes: DataFrame, largest: float) -> DataFrame:
    """(2 / largest) L - I with L = I - symmetric normalisation."""
    lap = combined((1, identity(nodes)), (-1, symmetric_normalised(a)))
    return combined((2.0 / largest, lap), (-1, identity(nodes)))


def times_dense(a: DataFrame, x: DataFrame) -> DataFrame:
    """A X for X as (id, k, x): the sum over neighbours, feature by feature."""
    return a.join(x.select(F.col("id").alias("j"), "k", "x"), "j").groupBy(F.col("i").alias("id"), "k").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def largest_eigenvalue(a: DataFrame, nodes: DataFrame, steps: int = 30) -> float:
    """Power iteration on a symmetric matrix; the vector stays a table."""
    x = nodes.select("id", F.lit(0).alias("k"), (F.lit(1.0) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x"))
    value = 0.0
    for step in range(steps):
        y = times_dense(a, x)
        value = y.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 0.0
        if not value:
            return 0.0
        x = y.withColumn("x", F.col("x") / F.lit(value))
        x = stored(x, "eigen")
    return float(value)
