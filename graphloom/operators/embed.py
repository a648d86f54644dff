"""Embedding methods, each a function from a graph to (id, vec)."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.dense import mapped, matrix_of
from graphloom.functions.numeric import l2_normalised
from graphloom.operators import factors, matrix, sampling, structure
from graphloom.operators.graph import PropertyGraph, ends, numbered
from graphloom.plans.storage import stored


#: Steps of walks that one task of the skip-gram trains on in a pass.
WORDS_A_PART = 2_000_000


#: Up to this many rows and columns MLlib decomposes, whose right vectors come to the driver.
LOCAL_SIDE = 20_000


def top_svd(a: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(id, vec) of left vectors, singular values, and (id, vec) of right vectors of a matrix (i, j, v), ids of any type.

    Only ids of a row or column that has entries come back, and as many values as are positive.
    Small matrices go to MLlib, entries and rows staying in the JVM; larger ones are decomposed by
    ``_subspace``, which brings no more than k x k numbers to the driver.
    """
    book = stored(numbered(a.select(F.explode(F.array("i", "j")).alias("id")).distinct(), F.col("id")), "svd-ids")
    low, high = book.select(F.col("id").alias("i"), F.col("idx").alias("_i")), book.select(F.col("id").alias("j"), F.col("idx").alias("_j"))
    held = stored(a.join(low, "i").join(high, "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), F.col("v").cast("double").alias("v")), "svd")
    size = book.count()
    left, s, right = (_in_mllib if size <= LOCAL_SIDE else _subspace)(held, size, min(k, size))
    named = lambda rows: rows.withColumnRenamed("id", "idx").join(book, "idx").select("id", "vec")
    return named(left), s, named(right)


def _in_mllib(a: DataFrame, size: int, k: int) -> tuple[DataFrame, np.ndarray, DataFrame]:
    from pyspark.ml.functions import vector_to_array
    from pyspark.mllib.common import callMLlibFunc
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix

    matrix_ = callMLlibFunc("createCoordinateMatrix", a, size, size)
    found = IndexedRowMatrix(matrix_.toIndexedRowMatrix()).computeSVD(k, computeU=True)
    rows = callMLlibFunc("getIndexedRows", found.U._java_matrix_wrapper._java_model)
    left = stored(rows.select(F.col("index").alias("id"), vector_to_array("vector").alias("vec")), "svd-left")
    v = found.V.toArray()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * v.shape[1], pa.int32()), pa.array(v.reshape(-1)))
    right = a.sparkSession.createDataFrame(pa.table({"id": pa.array(np.arange(size)), "vec": lists}))
    return left, np.array(found.s), right


def _subspace(a: DataFrame, size: int, k: int, extra: int = 8, rounds: int = 60, tolerance: float = 1e-7) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Subspace iteration from random vectors: products with the matrix are joins, orthogonal bases come of k x k Gram matrices.

    Stops when no value moves by more than ``tolerance`` of the largest from one round to the next.
    """
    width = min(k + extra, size)
    back = matrix.transposed(a)

    def basis(rows: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """Orthonormal columns that span those of rows, their scales, and the rotation."""
        wide = len(rows.first()["vec"])
        lam, u = np.linalg.eigh(factors.gram(rows, "vec", wide))
        order = [j for j in np.argsort(-lam) if lam[j] > 1e-14 * lam.max()]
        turn = u[:, order] / np.sqrt(lam[order])
        return stored(mapped(rows, "id", "vec", lambda batch: matrix_of(batch, "vec") @ turn), "basis"), np.sqrt(lam[order]), u[:, order]

    start = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.pmod(F.xxhash64("id", j), F.lit(1 << 30)) / float(1 << 29) - 1.0)
    q = a.select(F.col("j").alias("id")).distinct().select("id", start.alias("vec"))
    q, before = basis(stored(q, "start"))[0], None
    for _ in range(rounds):
        left, s, _ = basis(stored(factors.through(a, q, "vec", len(q.first()["vec"])), "product"))
        y = stored(factors.through(back, left, "vec", len(s)), "product")
        q, s, turn = basis(y)  # A' left = q s turn'
        if before is not None and len(before) == len(s) and np.abs(s - before)[:k].max() <= tolerance * s[0]:
            break
        before = s
    left = stored(mapped(left, "id", "vec", lambda batch: matrix_of(batch, "vec") @ turn[:, :k]), "svd-left")
    return left, s[:k], q.select("id", F.slice("vec", 1, min(k, len(s))).alias("vec"))


def _on_all(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """A vector for each node: zeros where there is none."""
    width = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    return nodes.select("id").distinct().join(vectors, "id", "left").select("id", F.coalesce("vec", F.array_repeat(F.lit(0.0), width)).alias("vec"))


def _scaled(vectors: DataFrame, by: np.ndarray) -> DataFrame:
    factors = F.array(*[F.lit(float(x)) for x in by])
    return vectors.select("id", F.zip_with("vec", factors, lambda x, y: x * y).alias("vec"))


def _concatenated(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.join(more.withColumnRenamed("vec", "_v"), "id").select("id", F.concat("vec", "_v").alias("vec"))
    return out


def hope(graph: PropertyGraph, dim: int) -> DataFrame:
    """Both singular sides of the two-step matrix, each scaled by the root of the values; zeros on a side without two-step paths."""
    if dim % 2:
        raise ValueError("an even dimension is needed")
    a = matrix.matrix(graph.edges)
    left, s, right = top_svd(matrix.product(a, a), dim // 2)
    return _concatenated([_on_all(_scaled(side, np.sqrt(s)), graph.nodes) for side in (left, right)])


def grarep(graph: PropertyGraph, dim: int, steps: int = 4) -> DataFrame:
    """For each power of the column-stochastic matrix the left singular side of its positive log, rows scaled to length 1; zeros where a node has no positive log."""
    if dim % steps:
        raise ValueError("the dimension must be a multiple of the number of steps")
    binary = graph.undirected().edges.withColumn("weight", F.lit(1.0))
    p = stored(matrix.column_stochastic(matrix.matrix(binary)), "transition")
    n, now, parts = ends(graph.edges).agg(F.count(F.lit(1)).alias("n")), p, []
    for step in range(steps):
        now = p if step == 0 else stored(matrix.product(now, p), "power")
        left, s, _ = top_svd(matrix.positive_log(now, n), dim // steps)
        parts.append(_scaled(left, np.sqrt(s)).select("id", l2_normalised(F.col("vec")).alias("vec")))
    return _concatenated([_on_all(part, graph.nodes) for part in parts])


def laplacian_map(graph: PropertyGraph, dim: int) -> DataFrame:
    """Eigenvectors of the normalised Laplacian for its smallest eigenvalues beyond the zeros.

    They are the largest of I + D^-1/2 A D^-1/2, which is positive semidefinite; as many trivial
    ones as there are components are dropped.
    """
    a = matrix.matrix(graph.edges)
    shifted = matrix.combined((1, matrix.identity(ends(graph.edges))), (1, matrix.symmetric_normalised(a)))
    parts = structure.connected_components(graph.edges).select("component").distinct().count()
    left, _, _ = top_svd(shifted, parts + dim)
    return left.select("id", F.slice("vec", parts + 1, dim).alias("vec"))


def _word2vec(walks: DataFrame, keys: list[str], dim: int, window: int, epochs: int, seed: int) -> DataFrame:
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    corpus = sampling.paths(walks, *keys).select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    held = stored(corpus, "corpus")
    # a task trains on the walks of its part, so parts grow in number, not in size; vectors are averaged after each pass
    parts = max(1, -(-(held.agg(F.sum(F.size("path"))).first()[0] or 0) // WORDS_A_PART))
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=0, maxIter=epochs, numPartitions=parts, seed=seed, inputCol="path", outputCol="_").fit(held)
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("vec"))


def deepwalk(graph: PropertyGraph, dim: int = 128, walks: int = 10, length: int = 80, window: int = 10, epochs: int = 5, seed: int = 32) -> DataFrame:
    """Skip-gram with hierarchical softmax over uniform walks; ids come back as strings."""
    return _word2vec(sampling.uniform_walks(graph.edges, length, walks, seed, nodes=graph.nodes), ["walk", "start"], dim, window, epochs, seed)


def node2vec(graph: PropertyGraph, dim: int = 128, walks: int = 10, length: int = 80, p: float = 1.0, q: float = 1.0, window: int = 10, epochs: int = 5, seed: int = 32) -> DataFrame:
    """Skip-gram over second-order walks from each node."""
    return _word2vec(sampling.biased_walks(graph.edges, length, p, q, seed, walks=walks, nodes=graph.nodes), ["walk", "start"], dim, window, epochs, seed)


def factorised(graph: PropertyGraph, dim: int = 16, epochs: int = 20, rate: float = 0.05, decay: float = 1e-4, seed: int = 32) -> DataFrame:
    """Graph factorisation by full-batch gradient steps: each edge's residual is a join, each node's gradient a sum."""
    edges = stored(graph.edges.where("weight > 0"), "edges")
    start = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (F.pmod(F.xxhash64(F.col("id"), k, F.lit(seed)), F.lit(20001)) / 10000.0 - 1.0) * 0.1)
    now = stored(ends(edges).select("id", start.alias("vec")), "vectors")
    for _ in range(epochs):
        both = edges.join(now.select(F.col("id").alias("src"), F.col("vec").alias("a")), "src").join(now.select(F.col("id").alias("dst"), F.col("vec").alias("b")), "dst")
        error = F.col("weight") - F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        pulls = both.withColumn("e", error).select(F.col("src").alias("id"), F.transform("b", lambda x: x * F.col("e")).alias("g"))
        summed = pulls.groupBy("id").agg(F.array(*[F.sum(F.col("g")[k]) for k in range(dim)]).alias("g"), F.count(F.lit(1)).alias("m"))
        step = F.zip_with("vec", "g", lambda x, g: x + rate * (g / F.col("m") - decay * x))
        now = stored(now.join(summed, "id", "left").select("id", F.coalesce(step, F.col("vec")).alias("vec")), "vectors")
    return now


METHODS: dict[str, Callable[..., DataFrame]] = {
    "deepWalk": deepwalk, "node2vec": node2vec, "grarep": grarep, "hope": hope, "lap": laplacian_map, "gf": factorised,
    "line": factors.line, "sdne": factors.sdne, "tadw": factors.tadw, "lle": factors.lle,
}


def embed(graph: PropertyGraph, method: str, **parameters) -> DataFrame:
    """(id, vec) by the method of that name."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    return METHODS[method](graph, **parameters)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
