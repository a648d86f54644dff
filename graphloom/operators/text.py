"""TF-IDF and cosine graphs of documents and vectors."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tfidf(docs: DataFrame, pattern: str = r"[\x20\x09-\x0D]+") -> DataFrame:
    """(doc_id, term, w): term count times ln((1 + n) / (1 + df)) + 1, each document scaled to length 1."""
    terms = docs.select("doc_id", F.explode(F.split(F.lower("text"), pattern)).alias("term")).where("term <> ''")
    tf = terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return weighed.select("doc_id", "term", (F.col("w") / size).alias("w"))


def cosine_graph(weights: DataFrame, k: int) -> DataFrame:
    """(src, dst, weight): each document's k most similar ones through the terms they share."""
    a, b = weights.select(F.col("doc_id").alias("src"), "term", F.col("w").alias("x")), weights.select(F.col("doc_id").alias("dst"), "term", F.col("w").alias("y"))
    sims = a.join(b, "term").where("src <> dst").groupBy("src", "dst").agg(F.sum(F.col("x") * F.col("y")).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return sims.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def nearest_neighbours(vectors: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", block: int = 16_384) -> DataFrame:
    """(src, dst, weight): k nearest by cosine, ties to the smaller id.

    Vectors are dealt into blocks, and once more into groups; a task holds one block, meets one
    group tile by tile and keeps the best k of each of its rows.  So a vector is copied as often as
    there are blocks and groups, and a row's lists are as many as there are groups.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    n = rows.count()
    blocks = max(1, -(-n // block))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(-(-tasks // blocks), n // 4096))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    some = lambda seed, count: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")
    own = rows.select(some(1, blocks).alias("b"), each(groups).alias("g"), F.lit(0).alias("side"), "id", "x")
    others = rows.select(each(blocks).alias("b"), some(2, groups).alias("g"), F.lit(1).alias("side"), "id", "x")
    place = (F.col("b") * groups + F.col("g")).cast("int").alias("place")
    dealt = own.unionByName(others).select(place, "side", "id", "x").repartitionById(blocks * groups, "place").sortWithinPartitions("place", "side", "id").drop("place")
    found = dealt.mapInArrow(_nearest(k), "src long, dst array<long>, weight array<double>")
    pairs = F.arrays_zip(F.transform("weight", lambda w: -w).alias("loss"), F.col("dst"))
    best = found.select("src", pairs.alias("p")).groupBy("src").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("p"))  # one list for each group
    return best.select("src", F.explode("p").alias("p")).select("src", F.col("p.dst").alias("dst"), (-F.col("p.loss")).alias("weight"))


def _largest(sims: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns, in this order, of all values above the row's floor that can be among its k largest; of equal ones the first."""
    above = sims > floor[:, None]
    if np.count_nonzero(above) <= 4 * k * len(sims) or sims.shape[1] <= k:
        return np.nonzero(above)
    least = -np.partition(-sims, k - 1, axis=1)[:, k - 1]  # NaNs last
    floor = np.where(np.isnan(least), -np.inf, np.maximum(least, floor))
    over = above & (sims > floor[:, None])
    row, col = np.nonzero(above & (sims == floor[:, None]))
    start = np.searchsorted(row, np.arange(len(sims)))
    some = np.arange(len(row)) - start[row] < (k - np.count_nonzero(over, axis=1))[row]
    over[row[some], col[some]] = True
    return np.nonzero(over)


def _nearest(k: int, tile: int = 4096, width: int = 1024):
    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def matrix(lists: pa.ListArray) -> np.ndarray:
        size = np.diff(lists.offsets.to_numpy())
        if lists.null_count or (size != size[0]).any():
            raise ValueError("vectors must not be null, and of one length")
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        held: list[tuple] = []
        state: dict = {}

        def absorb(ids: np.ndarray, other: np.ndarray) -> None:
            if not state:
                state["id"], state["x"] = np.concatenate([i for i, _ in own]), unit(np.concatenate([x for _, x in own]))
                state["w"], state["d"] = np.full((len(state["id"]), k), -np.inf), np.zeros((len(state["id"]), k), np.int64)
            other = unit(other)
            for lo in range(0, len(state["id"]), width):
                mine, w, d = (state[c][lo : lo + width] for c in ("id", "w", "d"))
                sims = state["x"][lo : lo + width] @ other.T
                at = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
                for row in np.flatnonzero(ids[at] == mine):
                    sims[row, ids == mine[row]] = -np.inf
                # ids ascend, also from tile to tile, so ties go to those that are held
                row, col = _largest(sims, w.min(axis=1), k)
                count = np.bincount(row, minlength=len(mine))
                place = k + np.arange(len(row)) - (np.cumsum(count) - count)[row]
                both = np.full((len(mine), k + count.max()), -np.inf)
                ends = np.zeros(both.shape, np.int64)
                both[:, :k], ends[:, :k] = w, d
                both[row, place], ends[row, place] = sims[row, col], ids[col]
                order = np.lexsort((ends, -both), axis=1)[:, :k]
                w[:], d[:] = np.take_along_axis(both, order, 1), np.take_along_axis(ends, order, 1)

        for batch in batches:
            side, ids = batch["side"].to_numpy(), batch["id"].to_numpy()
            vectors = matrix(batch["x"]) if len(batch) else np.zeros((0, 0))
            for rows, to in ((side == 0, own), (side == 1, held)):
                if rows.any():
                    to.append((ids[rows], vectors[rows]))
            while own and sum(len(i) for i, _ in held) >= tile:
                ids, vectors = (np.concatenate(c) for c in zip(*held))
                absorb(ids[:tile], vectors[:tile])
                held = [(ids[tile:], vectors[tile:])]
        if own and any(len(i) for i, _ in held):
            absorb(*(np.concatenate(c) for c in zip(*held)))
        for lo in range(0, len(state.get("id", ())), 2048):
            real = [np.isfinite(x) for x in state["w"][lo : lo + 2048]]
            dst = [x[r].tolist() for x, r in zip(state["d"][lo : lo + 2048], real)]
            weight = [x[r].tolist() for x, r in zip(state["w"][lo : lo + 2048], real)]
            yield pa.RecordBatch.from_arrays([pa.array(state["id"][lo : lo + 2048]), pa.array(dst, pa.list_(pa.int64())), pa.array(weight, pa.list_(pa.float64()))], ["src", "dst", "weight"])

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
