"""Joins and components that hold where one key has a large part of all rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.storage import stored

#: A key is hot from this part of all rows on.
HOT_SHARE = 256
#: Tables of at most this many bytes, as counted by ``size``, are broadcast whole.
BROADCAST_BYTES = 4 << 20


def size(table: DataFrame) -> int:
    """16 bytes for each value, those of strings and of structs as text, and 48 for each element of an array."""
    kinds = {f.name: f.dataType.typeName() for f in table.schema.fields}
    texts = [F.octet_length(name) for name, kind in kinds.items() if kind == "string"]
    texts += [F.octet_length(F.col(name).cast("string")) for name, kind in kinds.items() if kind == "struct"]
    texts += [48 * F.greatest(F.size(name), F.lit(0)) for name, kind in kinds.items() if kind == "array"]
    long = sum((F.coalesce(F.sum(t), F.lit(0)) for t in texts), F.lit(0)).alias("b")
    row = table.agg(F.count(F.lit(1)).alias("n"), long).first()
    return 16 * len(table.columns) * row["n"] + int(row["b"])


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``totals``, which has one row for each key and, in ``count``, how many rows the key has.

    ``totals`` is measured, and broadcast where it is small.  Else rows of keys that hold over
    1/``HOT_SHARE`` of ``total`` rows stay in their tasks: there are fewer than ``HOT_SHARE`` such keys
    whatever the data, so their totals are broadcast.  Null keys go.  Give ``totals`` as a stored
    table of numbers and strings, for it is read several times.
    """
    if size(totals) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(totals), keys)
    bar = total // HOT_SHARE
    marked = rows.join(F.broadcast(totals.where(F.col(count) > bar)), keys, "left")
    cold = marked.where(F.col(count).isNull()).select(*rows.columns)
    return marked.where(F.col(count).isNotNull()).unionByName(cold.join(totals.where(F.col(count) <= bar), keys))


def _stats(edges: DataFrame) -> tuple[int, object]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of the task, by union and find."""
    parent: dict = {}

    def find(x):
        while (above := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[above]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "root"])


def forest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The minimum spanning forest of the edges (u, v, weight) of the task, ties broken by (u, v), by Boruvka's rounds on arrays."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    table = table.append_column("_known", table["weight"].is_valid())  # null weights come first, as in Spark
    table = table.sort_by([(c, "ascending") for c in ("_known", "weight", "u", "v")]).drop_columns(["_known"])
    m = table.num_rows
    code = pa.chunked_array(table["u"].chunks + table["v"].chunks).combine_chunks().dictionary_encode().indices.to_numpy()
    a, b = code[:m].astype(np.int64), code[m:].astype(np.int64)
    n, place, chosen = int(code.max(initial=-1)) + 1, np.arange(m), []
    while True:
        cross = a != b
        a, b, place = a[cross], b[cross], place[cross]
        if not len(a):
            break
        least = np.full(n, len(a))
        np.minimum.at(least, np.concatenate([a, b]), np.tile(np.arange(len(a)), 2))
        mine = np.flatnonzero(least < len(a))
        best = least[mine]
        chosen.append(place[np.unique(best)])
        root = np.arange(n)
        root[mine] = a[best] + b[best] - mine  # the other end
        both = root[root] == np.arange(n)  # two that chose the same edge: the smaller one stays
        root[both] = np.minimum(root, np.arange(n))[both]
        while ((above := root[root]) != root).any():
            root = above
        a, b = root[a], root[b]
    keep = np.sort(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
    yield from table.take(keep).combine_chunks().to_batches()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the least node of its component.

    Nulls and loops are dropped.  Alternates large and small stars (Kiveris et al. 2014), so rounds
    grow with the logarithm of the graph.  Each step aggregates, writes the least neighbour and the
    degree of each node, and joins them to the edges; edges of the nodes of highest degree stay in their tasks.
    Edges that measure no more than a table to be broadcast are joined in one task instead.
    """
    ordered = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state, mark = stored(ordered.distinct(), name), None
    if size(state) <= BROADCAST_BYTES:
        kind = state.schema["u"].dataType.simpleString()
        return stored(state.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"), name)
    while (now := _stats(state)) != mark and now[0]:
        mark, total = now, now[0]
        # the larger neighbours of each node move to the least node near it
        both = state.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-near")
        moved = join_totals(both.where("v > u"), least, ["u"], "n", 2 * total)
        large = stored(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{name}-large")
        # each node and its smaller neighbours move to the least of them; there are at most as many edges as before
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-low")
        moved = join_totals(large, low, ["u"], "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = stored(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
    # a star forest: one edge for each node that is not a root
    pairs = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())


cloudpickle.register_pickle_by_value(sys.modules[__name__])
