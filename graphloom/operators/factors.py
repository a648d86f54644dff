"""Embeddings by gradient steps and alternating factors: LINE, SDNE, TADW and LLE.

Vectors of nodes are tables.  Matrices of the size of a vector or a feature row are on the
driver; SDNE, whose outer layers are as wide as the graph, checks that they fit.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import numeric as N
from graphloom.functions.dense import Adam, flattened, glorot, mapped, matrix_of, partition_sums, split_like
from graphloom.operators import matrix, sampling
from graphloom.operators.graph import PropertyGraph, ends
from graphloom.plans.storage import stored

#: Most weights of SDNE's outer layers together: 200 MB in every task.
OUTER_WEIGHTS = 25_000_000
SLICE = 256


def _random_vector(dim: int, seed: int, size: float, *keys: Column) -> Column:
    """A vector from [-size, size), a function of the keys and the seed."""
    draw = lambda k: F.pmod(F.xxhash64(*keys, k, F.lit(seed)), F.lit(1 << 30)) / float(1 << 29) - 1.0
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: draw(k) * size)


def _fraction(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) * F.lit(2.0**-53)


def drawing_table(shares: DataFrame, key: str, prob: str) -> tuple[DataFrame, int]:
    """(bucket, key, lo, hi) and the number of buckets: [0, 1) cut into the shares of the keys.

    Each range of keys is summed for itself and moved by the sums of those before it.  A key is
    listed in every bucket of equal width that its part of [0, 1) touches, so draws find it by an
    equality join, and draws of a frequent key are spread over its buckets.
    """
    parts = int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = stored(shares.select(key, prob).repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), "shares")
    inner = Window.partitionBy("_part").orderBy(key)
    total = lambda w, end: F.coalesce(F.sum(prob).over(w.rowsBetween(Window.unboundedPreceding, end)), F.lit(0.0))
    sizes = held.groupBy("_part").agg(F.sum(prob).alias(prob), F.count(F.lit(1)).alias("n"))  # one row for each range
    base = sizes.select("_part", total(Window.orderBy("_part"), -1).alias("_base"))
    whole, count = sizes.agg(F.sum(prob), F.sum("n")).first()
    cut = held.select("_part", key, total(inner, -1).alias("lo"), total(inner, 0).alias("hi")).join(F.broadcast(base), "_part")
    cut = cut.select(key, *[((F.col(c) + F.col("_base")) / whole).alias(c) for c in ("lo", "hi")])
    first, last = F.floor(F.col("lo") * count), F.least(F.floor(F.col("hi") * count), F.lit(count - 1))
    return cut.select(F.explode(F.sequence(F.least(first, last), last)).alias("bucket"), key, "lo", "hi"), count


def drawn(rows: DataFrame, table: DataFrame, buckets: int, u: Column) -> DataFrame:
    """``rows`` joined to the key that holds the draw ``u`` from [0, 1)."""
    marked = rows.withColumn("_u", u).withColumn("bucket", F.floor(F.col("_u") * buckets))
    return marked.join(table, "bucket").where("_u >= lo and _u < hi").drop("_u", "bucket", "lo", "hi")


def line_loss(pairs: DataFrame, heads: DataFrame, tails: DataFrame) -> DataFrame:
    """(loss): minus the mean log-sigmoid of sign * head . tail over pairs (h, t, sign) and (id, vec) tables."""
    both = pairs.join(heads.select(F.col("id").alias("h"), F.col("vec").alias("a")), "h").join(tails.select(F.col("id").alias("t"), F.col("vec").alias("b")), "t")
    return both.agg((-F.avg(N.log_sigmoid(F.col("sign") * N.dot(F.col("a"), F.col("b"))))).alias("loss"))


def _line(edges: DataFrame, dim: int, order: int, negatives: int, epochs: int, rate: float, seed: int) -> DataFrame:
    """Adam steps over all arcs, weighted, each with ``negatives`` tails drawn anew from the noise distribution."""
    tail, nodes = order - 1, ends(edges)
    mean = edges.agg(F.avg("weight")).first()[0] or 1.0
    arcs = stored(edges.select(F.col("src").alias("h"), F.col("dst").alias("t"), (F.col("weight") / mean).alias("w")), "arcs")
    table, buckets = drawing_table(sampling.noise(edges), "id", "prob")
    table = stored(table.withColumnRenamed("id", "t"), "noise")
    zeros = F.array_repeat(F.lit(0.0), dim)
    kinds = nodes.select(F.explode(F.array(*[F.lit(k) for k in range(order)])).alias("kind"), "id")
    now = stored(kinds.select("kind", "id", _random_vector(dim, seed, 0.5 / dim, F.col("kind"), F.col("id")).alias("vec"), zeros.alias("m"), zeros.alias("v")), "vectors")
    for epoch in range(1, epochs + 1):
        tries = arcs.select("h", F.col("t").alias("_t"), "w", F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("r"))
        noise = drawn(tries, table, buckets, _fraction(F.col("h"), F.col("_t"), F.col("r"), F.lit(epoch), F.lit(seed)))
        pairs = arcs.select("h", "t", "w", F.lit(1.0).alias("sign")).unionByName(noise.select("h", "t", "w", F.lit(-1.0).alias("sign")))
        a = now.where("kind = 0").select(F.col("id").alias("h"), F.col("vec").alias("a"))
        b = now.where(f"kind = {tail}").select(F.col("id").alias("t"), F.col("vec").alias("b"))
        pull = F.col("w") * F.col("sign") * N.sigmoid(-F.col("sign") * N.dot(F.col("a"), F.col("b")))
        both = pairs.join(a, "h").join(b, "t").withColumn("c", pull)
        moves = both.select(F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), F.col("h").alias("id"), F.transform("b", lambda x: x * F.col("c")).alias("g")),
            F.struct(F.lit(tail).alias("kind"), F.col("t").alias("id"), F.transform("a", lambda x: x * F.col("c")).alias("g")),
        )).alias("s")).select("s.*")
        sums = moves.groupBy("kind", "id").agg(F.array(*[F.sum(F.col("g")[k]) for k in range(dim)]).alias("g"))
        joined = now.join(sums, ["kind", "id"], "left").withColumn("g", F.coalesce("g", zeros))
        joined = joined.withColumns({"m": F.zip_with("m", "g", lambda m, g: 0.9 * m + 0.1 * g), "v": F.zip_with("v", "g", lambda v, g: 0.999 * v + 0.001 * g * g)})
        step = F.zip_with("m", "v", lambda m, v: rate * (m / (1 - 0.9**epoch)) / (F.sqrt(v / (1 - 0.999**epoch)) + 1e-8))
        now = stored(joined.select("kind", "id", F.zip_with("vec", step, lambda x, s: x + s).alias("vec"), "m", "v"), "vectors")
    return now.where("kind = 0").select("id", "vec")


def line(graph: PropertyGraph, dim: int = 128, order: int = 3, negatives: int = 5, epochs: int = 10, rate: float = 0.025, seed: int = 32) -> DataFrame:
    """First-order (1) or second-order (2) proximity, or both side by side with half the places each (3)."""
    if order not in (1, 2, 3) or (order == 3 and dim % 2):
        raise ValueError("order is 1, 2 or 3; order 3 needs an even dimension")
    edges = stored(graph.edges.where("weight > 0").select("src", "dst", "weight"), "edges")
    if order < 3:
        return _line(edges, dim, order, negatives, epochs, rate, seed)
    one, two = (_line(edges, dim // 2, k, negatives, epochs, rate, seed + k) for k in (1, 2))
    return one.join(two.withColumnRenamed("vec", "_v"), "id").select("id", F.concat("vec", "_v").alias("vec"))


def _leaky(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0.2 * z)


def _dense_slices(batch: pa.RecordBatch, n: int):
    """(slice, rows as a dense matrix) for at most SLICE rows at a time."""
    columns, values = batch.column(batch.schema.get_field_index("cols")), batch.column(batch.schema.get_field_index("vals"))
    for first in range(0, batch.num_rows, SLICE):
        c, v = columns.slice(first, SLICE), values.slice(first, SLICE)
        lengths = np.diff(c.offsets.to_numpy())
        dense = np.zeros((len(lengths), n))
        dense[np.repeat(np.arange(len(lengths)), lengths), c.flatten().to_numpy()] = v.flatten().to_numpy()
        yield slice(first, first + len(lengths)), dense


def _encode(x: np.ndarray, weights: list[np.ndarray], upto: int) -> list[np.ndarray]:
    """Outputs of the first ``upto`` layers, the input first."""
    out = [x]
    for k in range(upto):
        out.append(_leaky(out[-1] @ weights[2 * k] + weights[2 * k + 1]))
    return out


def sdne(
    graph: PropertyGraph, layers: tuple[int, ...] = (1000, 128), alpha: float = 1e-6, beta: float = 5.0, nu1: float = 1e-5, nu2: float = 1e-4,
    epochs: int = 20, rate: float = 0.01, by_pair: bool = False, seed: int = 32,
) -> DataFrame:
    """(id, vec): the middle layer of an autoencoder of adjacency rows, whose width is the last of ``layers``.

    The loss is the squared error of the rows, times ``beta`` squared at non-zeros, plus ``alpha``
    times the weighted squared distances of neighbours, plus ``nu1`` and ``nu2`` times the absolute
    and squared weights; steps go over all rows.  ``by_pair`` counts a row once for each arc at it.
    The outer layers are as wide as the graph and a row is made dense to be reconstructed, as the
    loss asks; a graph with more than OUTER_WEIGHTS of them is an error.
    """
    coded = graph.encoded()
    book = stored(coded.nodes.select("id", "idx"), "book")
    edges = stored(coded.edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")
    n = book.count()
    if 2 * n * layers[0] > OUTER_WEIGHTS:
        raise ValueError(f"{n} nodes by {layers[0]} units are more than {OUTER_WEIGHTS} weights; take a smaller first layer or another method")
    sizes = (n, *layers, *layers[-2::-1], n)
    rng, depth, adam = np.random.default_rng(seed), len(layers), Adam(rate)
    weights = [part for a, b in zip(sizes, sizes[1:]) for part in (glorot(rng, a, b), np.zeros(b))]
    entries = edges.groupBy(F.col("src").alias("idx")).agg(F.collect_list(F.struct(F.col("dst").cast("int").alias("c"), F.col("weight").cast("double").alias("w"))).alias("e"))
    at = edges.select(F.explode(F.array("src", "dst")).alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).cast("double").alias("arcs"))
    rows = book.join(entries, "idx", "left").join(at, "idx", "left")
    cells = lambda name, kind: F.coalesce(F.col("e").getField(name), F.array().cast(f"array<{kind}>"))
    rows = stored(rows.select("idx", cells("c", "int").alias("cols"), cells("w", "double").alias("vals"), (F.coalesce("arcs", F.lit(0.0)) if by_pair else F.lit(1.0)).alias("share")), "rows")

    def encoded() -> DataFrame:
        held = [w.copy() for w in weights[: 2 * depth]]
        return mapped(rows, "idx", "y", lambda batch: np.vstack([_encode(x, held, depth)[-1] for _, x in _dense_slices(batch, n)]))

    for _ in range(epochs):
        y = stored(encoded(), "code")
        a, b = y.select(F.col("idx").alias("src"), F.col("y").alias("a")), y.select(F.col("idx").alias("dst"), F.col("y").alias("b"))
        apart = edges.join(a, "src").join(b, "dst").withColumn("d", F.zip_with("a", "b", lambda p, q: 2 * alpha * F.col("weight") * (p - q)))
        ways = apart.select(F.explode(F.array(F.struct(F.col("src").alias("idx"), F.col("d")), F.struct(F.col("dst").alias("idx"), F.transform("d", lambda x: -x).alias("d")))).alias("s")).select("s.*")
        pulls = ways.groupBy("idx").agg(F.array(*[F.sum(F.col("d")[k]) for k in range(layers[-1])]).alias("pull"))
        ready = rows.join(pulls, "idx", "left").withColumn("pull", F.coalesce("pull", F.array_repeat(F.lit(0.0), layers[-1])))

        def add(batch: pa.RecordBatch) -> np.ndarray:
            pull, share = matrix_of(batch, "pull"), batch.column(batch.schema.get_field_index("share")).to_numpy()
            total = [np.zeros_like(w) for w in weights]
            for part, x in _dense_slices(batch, n):
                outs = _encode(x, weights, 2 * depth)
                delta = 2 * (outs[-1] - x) * np.where(x != 0, beta * beta, 1.0) * share[part, None]
                for k in range(2 * depth - 1, -1, -1):
                    if k == depth - 1:
                        delta = delta + pull[part]
                    delta = delta * np.where(outs[k + 1] > 0, 1.0, 0.2)
                    total[2 * k] += outs[k].T @ delta
                    total[2 * k + 1] += delta.sum(0)
                    delta = delta @ weights[2 * k].T
            return flattened(total)

        found = split_like(partition_sums(ready, add, sum(w.size for w in weights)), weights)
        adam.move(weights, [g + nu1 * np.sign(w) + 2 * nu2 * w if w.ndim == 2 else g for g, w in zip(found, weights)])
    return encoded().join(book, "idx").select("id", F.col("y").alias("vec"))


def through(m: DataFrame, rows: DataFrame, name: str, width: int) -> DataFrame:
    """(id, name): for each row i of ``m`` the sum of v(i, j) times the vector of j."""
    both = m.join(rows.select(F.col("id").alias("j"), F.col(name).alias("_v")), "j")
    return both.groupBy(F.col("i").alias("id")).agg(F.array(*[F.sum(F.col("v") * F.col("_v")[k]) for k in range(width)]).alias(name))


def gram(rows: DataFrame, name: str, size: int) -> np.ndarray:
    return partition_sums(rows, lambda batch: (matrix_of(batch, name).T @ matrix_of(batch, name)).reshape(-1), size * size).reshape(size, size)


def tadw(graph: PropertyGraph, features: DataFrame, dim: int = 128, lamb: float = 0.2, rounds: int = 20, most: int = 200, seed: int = 32) -> DataFrame:
    """(id, vec) from the graph and (id, features): factors W and H with M close to W' H T, found in turn.

    M averages the column-stochastic matrix and its square; T holds features, projected on their
    ``most`` strongest directions if there are more.  Each turn solves its quadratic exactly: W by a
    system of half the dimension, H in the eigenvectors of W W' and T T'.  A vector is the node's
    column of W and of H T, each scaled to length 1.  Nodes without features take no part.
    """
    if dim % 2:
        raise ValueError("an even dimension is needed")
    half = dim // 2
    binary = graph.undirected().edges.withColumn("weight", F.lit(1.0))
    p = stored(matrix.column_stochastic(matrix.matrix(binary)), "transition")
    m = stored(matrix.tadw_target(p), "target")
    t = stored(features.select("id", F.transform("features", lambda x: x.cast("double")).alias("t")), "features")
    width = t.agg(F.max(F.size("t"))).first()[0]

    tt = gram(t, "t", width)
    if width > most:
        axes = np.linalg.eigh(tt)[1][:, ::-1][:, :most]
        t, width = stored(mapped(t, "id", "t", lambda batch: matrix_of(batch, "t") @ axes), "features"), most
        tt = axes.T @ tt @ axes
    gamma, v = np.linalg.eigh(tt)
    h = np.random.default_rng(seed).standard_normal((half, width))
    w = None
    for _ in range(rounds):
        left = 2 * h @ tt @ h.T + lamb * np.eye(half)
        solved = 2 * np.linalg.inv(left)
        moved = through(m, mapped(t, "id", "x", lambda batch, h=h: matrix_of(batch, "t") @ h.T), "x", half)
        w = stored(mapped(moved, "id", "w", lambda batch, s=solved: matrix_of(batch, "x") @ s), "factor")
        cross = through(m, w, "w", half).join(t, "id")
        c = partition_sums(cross, lambda batch: (matrix_of(batch, "w").T @ matrix_of(batch, "t")).reshape(-1), half * width).reshape(half, width)
        lam, u = np.linalg.eigh(gram(w, "w", half))
        h = u @ ((u.T @ c @ v) / (np.outer(lam, gamma) + lamb)) @ v.T
    text = mapped(t, "id", "x", lambda batch, h=h: matrix_of(batch, "t") @ h.T)
    zeros = F.array_repeat(F.lit(0.0), half)
    return text.join(w, "id", "left").select("id", F.concat(N.l2_normalised(F.coalesce("w", zeros)), N.l2_normalised(F.col("x"))).alias("vec"))


def lle(graph: PropertyGraph, dim: int = 128) -> DataFrame:
    """(id, vec): right singular vectors of I - P for its smallest values but the first; P has rows of sum 1.

    They are the largest of c I - (I - P)' (I - P), where c is the product of I - P's largest column
    and row sums of absolute values.
    """
    from graphloom.operators.embed import top_svd

    both = graph.undirected().edges
    away = stored(matrix.combined((1, matrix.identity(ends(both))), (-1, matrix.row_l1(matrix.matrix(both)))), "away")
    most = lambda key: away.groupBy(key).agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s")).first()[0]
    c = most("i") * most("j")
    shifted = matrix.combined((c, matrix.identity(ends(both))), (-1, matrix.product(matrix.transposed(away), away)))
    left, _, _ = top_svd(shifted, dim + 1)
    return left.select("id", F.slice("vec", 2, dim).alias("vec"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
