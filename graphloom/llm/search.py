"""Exact top-k inner products of a query set against all vectors, as tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import workspace

SCALE = 64
#: Queries of a block, fewer where they would take more than BLOCK_BYTES as 64-bit integers.
BLOCK, BLOCK_BYTES = 32_768, 64 << 20
TILE_QUERIES, TILE_ROWS, FAN_IN = 512, 4096, 64
#: A task has at least this many vectors, unless there are fewer, so that its lists are short beside them.
SHARD_ROWS = 16_384
#: Components below this are multiplied as machine integers, others as Python's.
WIDE = 1 << 24
LOW, HIGH = -(1 << 63) + 2, (1 << 63) - 1
_ROW = "rid long, vec_id long, q binary"
_KINDS = {b"h": np.int16, b"i": np.int32}


def _encoded(scaled: np.ndarray, values: np.ndarray) -> bytes:
    """A letter for the width of its integers, then floor(64 * x) of one vector; large ones as decimal text."""
    top = float(np.abs(scaled).max(initial=0))
    if top < WIDE:
        kind = b"h" if top < 32_768 else b"i"
        return kind + scaled.astype(_KINDS[kind]).tobytes()
    exact = [int(s) if abs(s) < 2**53 else int(x) * SCALE for s, x in zip(scaled.tolist(), values.tolist())]  # so large an x is a whole number
    return b"t" + " ".join(map(str, exact)).encode()


def quantised(vectors: DataFrame) -> DataFrame:
    """rid, vec_id and floor(64 * x) of each component, see ``_encoded``.

    Vectors that are null or hold a null or a non-finite component are left out.
    rid numbers the rows, so rows of one id are told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            flat = lists.values.cast(pa.float64())
            values = flat.to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # nulls are NaN here
            offsets = lists.offsets.to_numpy()
            starts, ends = offsets[:-1], offsets[1:]
            good = (bad[ends] == bad[starts]) & lists.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(SCALE * values)
            at = np.flatnonzero(good)
            blobs = [_encoded(scaled[starts[k] : ends[k]], values[starts[k] : ends[k]]) for k in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid + at, pa.int64()), ids.take(pa.array(at)).cast(pa.int64()), pa.array(blobs, pa.binary())], ["rid", "vec_id", "q"]
            )
            rid += len(ids)

    return vectors.select("vec_id", "embedding").mapInArrow(run, _ROW)


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of equal width, shorter ones with zeros at their ends; of Python's integers if one is large."""
    wide = any(b[:1] == b"t" for b in blobs)
    out = np.zeros((len(blobs), width), object if wide else np.int64)
    for k, b in enumerate(blobs):
        row = [int(x) for x in b[1:].split()] if b[:1] == b"t" else np.frombuffer(b, _KINDS[b[:1]], offset=1)
        out[k, : len(row)] = [int(x) for x in row] if wide else row
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products, cut to 64 bits at the end; floats where no sum can leave their exact range."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    for limit, kind in ((1 << 24, np.float32), (1 << 53, np.float64), (1 << 62, np.int64)):
        if most < limit:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LOW, HIGH).astype(np.int64)


def _select(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to the smaller column."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    span = int(scores.max()) - int(scores.min()) + 1
    if span < (1 << 62) // n:  # one key that holds score and column
        keys = (scores - scores.min()) * n + np.arange(n - 1, -1, -1)
        return np.argpartition(keys, n - k, axis=1)[:, n - k :]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _partial(dealt: DataFrame, width: int, k: int) -> DataFrame:
    """Each task's best k for each query of its block: query row, query id, group, and a sorted list.

    Rows are (group, side, rid, vec_id, q); those of side 0, the block's queries, come first in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.iinfo(np.int64).min
        asked: list[tuple] = []
        rows: list[tuple] = []
        state: dict = {}

        def begin() -> None:
            asked.sort(key=lambda x: x[2][:1] == b"t")
            state["rid"] = np.array([x[0] for x in asked], np.int64)
            state["id"] = [x[1] for x in asked]
            split = sum(x[2][:1] != b"t" for x in asked)
            state["q"] = [_matrix([x[2] for x in asked[:split]], width), _matrix([x[2] for x in asked[split:]], width)]
            state["top"] = [np.zeros((len(asked), 0), np.int64)] * 4

        def absorb(rows: list[tuple]) -> None:
            rows.sort(key=lambda x: (x[1] is None, x[1] or 0, x[0]))  # columns then stand in the order of ids
            ids, nulls = np.array([x[1] or 0 for x in rows]), np.array([x[1] is None for x in rows], np.int64)
            rids, m = np.array([x[0] for x in rows]), _matrix([x[2] for x in rows], width)
            parts, first = [], 0
            for q in state["q"]:
                for lo in range(0, len(q), TILE_QUERIES):
                    scores = _products(q[lo : lo + TILE_QUERIES], m)
                    mine = state["rid"][first + lo : first + lo + len(scores), None] == rids[None, :]
                    scores[mine] = int(scores.min()) - 1  # the query's own row
                    at = _select(scores, k)
                    picked = np.take_along_axis(scores, at, 1)
                    own = np.take_along_axis(mine, at, 1)
                    parts.append((np.where(own, none, picked), ids[at], rids[at], nulls[at]))
                first += len(q)
            if not parts:
                return
            s, v, r, z = (np.concatenate(x) for x in zip(*parts))
            s, v, r, z = (np.concatenate([a, b], 1) for a, b in zip(state["top"], (s, v, r, z)))
            order = np.lexsort((r, v, z, -(s + 1)), axis=1)[:, :k]
            state["top"] = [np.take_along_axis(a, order, 1) for a in (s, v, r, z)]

        group = 0
        for batch in batches:
            for g, side, *row in zip(*(batch.column(j).to_pylist() for j in range(5))):
                group = g
                (rows if side else asked).append(tuple(row))
            while len(rows) >= TILE_ROWS:
                if not state:
                    begin()
                absorb(rows[:TILE_ROWS])
                rows = rows[TILE_ROWS:]
        if not state:
            begin()
        for wide in (False, True):  # large numbers in a tile of their own
            if rest := [x for x in rows if (x[2][:1] == b"t") == wide]:
                absorb(rest)
        kind = pa.list_(pa.struct([("loss", pa.int64()), ("unknown", pa.int32()), ("vec_id", pa.int64()), ("rid", pa.int64())]))
        for lo in range(0, len(asked) if state["top"][0].shape[1] else 0, 2048):
            lists = [
                [{"loss": -s, "unknown": z, "vec_id": v, "rid": r} for s, v, r, z in zip(*x) if s != none]
                for x in zip(*(state["top"][j][lo : lo + 2048].tolist() for j in (0, 1, 2, 3)))
            ]
            hi = lo + len(lists)
            yield pa.RecordBatch.from_arrays(
                [pa.array(state["rid"][lo:hi], pa.int64()), pa.array(state["id"][lo:hi], pa.int64()), pa.array([group] * len(lists), pa.int32()), pa.array(lists, kind)],
                ["query_rid", "query_id", "part", "top"],
            )

    return dealt.mapInArrow(run, "query_rid long, query_id long, part int, top array<struct<loss:long,unknown:int,vec_id:long,rid:long>>")


def _merge(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """Tree merge: FAN_IN lists of a query at a time, so no group is larger than FAN_IN * k."""
    while parts > 1:
        parts = -(-parts // FAN_IN)
        lists = lists.groupBy("query_rid", "query_id", F.pmod("part", F.lit(parts)).alias("part")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        )
    return lists


def top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products.

    ``is_query`` is a condition on vec_id.  A query's own row is no candidate of it; other rows of
    its id are.  Ties go to the smaller vec_id, null ids last, then to the earlier row.  Fewer
    candidates than k give fewer rows; repeated queries give repeated lists; an empty table gives none.
    A component counts as floor(64 * x), a missing one of a shorter or an empty vector as 0; vectors
    that are null or hold a null or a non-finite component take no part.  Products are exact; scores
    beyond 64 bits are cut to the largest or least that fit, and tie there.

    Queries are dealt into blocks and vectors into groups; a task multiplies the queries of one block
    with the vectors of one group, tile by tile, and keeps its best k for each query.
    """
    spark = vectors.sparkSession
    held = workspace.keep(quantised(vectors), "search-vectors")
    letter, rest = F.substring("q", 1, 1), F.length("q") - 1
    size = F.when(letter == F.lit(b"h"), rest / 2).when(letter == F.lit(b"i"), rest / 4).otherwise(F.size(F.split(F.col("q").cast("string"), " ")))
    n, width, asked = held.agg(F.count(F.lit(1)), F.max(size.cast("int")), F.count(F.when(is_query, 1))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-asked // max(TILE_QUERIES, min(BLOCK, BLOCK_BYTES // (8 * max(width, 1)))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(-(-tasks // blocks), n // SHARD_ROWS))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(int(count) - 1)))
    some = lambda seed, count: F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(int(count))).cast("int")
    queries = held.where(is_query).select(some(1, blocks).alias("block"), each(groups).alias("group"), F.lit(0).alias("side"), "rid", "vec_id", "q")
    others = held.select(each(blocks).alias("block"), some(2, groups).alias("group"), F.lit(1).alias("side"), "rid", "vec_id", "q")
    place = (F.col("block") * int(groups) + F.col("group")).cast("int").alias("place")
    dealt = queries.unionByName(others).select(place, "group", "side", "rid", "vec_id", "q").repartitionById(int(blocks * groups), "place").sortWithinPartitions("place", "side").drop("place")
    tops = workspace.keep(_merge(_partial(dealt, int(width), k), k, int(groups)), "search-tops")
    return tops.select("query_id", F.posexplode("top").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.when(F.col("x.unknown") == 0, F.col("x.vec_id")).alias("vec_id"), (-F.col("x.loss")).alias("score")
    )


ORACLE = """
    with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
               where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) as bigint) as score
          from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20
"""

workspace.ship(__name__)
