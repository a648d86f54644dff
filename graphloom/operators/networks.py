"""Graph convolutions, link prediction, label ranking and the projection on principal components.

Vectors of nodes are rows; a propagation is a join with the matrix and an aggregation.  Only
weight matrices, whose size doesn't depend on the graph, are on the driver.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import numeric as N
from graphloom.functions.dense import Adam, DenseNet, fit_dense, glorot, kept, mapped, matrix_of, numbers_of, partition_sums
from graphloom.operators import evaluate, matrix
from graphloom.plans.storage import stored


#: Graphs of at most this many bytes are trained in one process.
LOCAL_BYTES = 128 << 20
#: Arcs of a block of a product in one process: its rows stay in the cache.
BLOCK = 1 << 14


def supports(*matrices: DataFrame) -> DataFrame:
    """(i, j, s, v): the matrices one after the other, numbered by s."""
    rows = None
    for s, a in enumerate(matrices):
        part = a.select("i", "j", F.lit(s).alias("s"), "v")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _spread(held: DataFrame, rows: DataFrame, name: str, width: int) -> DataFrame:
    """Z = sum over s of S_s H_s, where a row of ``rows`` has H_0, H_1, ... side by side."""
    parts = held.join(rows.select(F.col("id").alias("j"), F.col(name).alias("_v")), "j")
    sums = [F.sum(F.col("v") * F.col("_v")[F.col("s") * width + k]) for k in range(width)]
    return parts.groupBy(F.col("i").alias("id")).agg(F.array(*sums).alias(name))


def _gathered(held: DataFrame, rows: DataFrame, name: str, width: int, count: int) -> DataFrame:
    """The transpose of ``_spread``: gradients of H_0, H_1, ... side by side."""
    parts = held.join(rows.select(F.col("id").alias("i"), F.col(name).alias("_v")), "i")
    sums = [F.coalesce(F.sum(F.when(F.col("s") == s, F.col("v") * F.col("_v")[k])), F.lit(0.0)) for s in range(count) for k in range(width)]
    return parts.groupBy(F.col("j").alias("id")).agg(F.array(*sums).alias(name))


def split_nodes(labels: DataFrame, ratio: float, validation: int = 100, seed: int = 0, order: str = "id") -> DataFrame:
    """``labels`` with ``part`` train, val or test.

    Of the ``ratio`` that isn't tested the last ``validation`` validate, at most half of it.
    """
    cut = int(ratio * labels.count())
    return evaluate.permutation_split(labels, ratio, seed, order).withColumn(
        "part", F.when(F.col("place") < cut - min(validation, cut // 2), "train").when(F.col("place") < cut, "val").otherwise("test")
    )


def train_convolution(
    features: DataFrame, held: DataFrame, marks: DataFrame, classes: int, hidden: int = 16, epochs: int = 200, rate: float = 0.01,
    decay: float = 5e-4, dropout: float = 0.5, patience: int = 10, seed: int = 123, terms: tuple[DataFrame, int] | None = None,
) -> tuple[DataFrame, list[dict]]:
    """Two graph convolutions, relu between them; returns (id, hidden, probs) and the history.

    ``features`` is (id long, features), ``held`` the supports (i, j, s, v), ``marks`` (id, y, part).
    The loss is the mean cross-entropy of train nodes plus decay / 2 times the squares of the first
    layer.  Training ends when a val loss exceeds the mean of the ``patience`` before it.  Rows of
    features must be equally long; ids must not repeat.

    A graph whose features, supports and marks take at most ``LOCAL_BYTES`` is trained in one process,
    by the same steps with the same draws; a larger one by joins and sums over partitions.  ``terms``:
    a matrix and the order to which ``held`` has its Chebyshev terms.  One process then needs the
    matrix alone, for it gets a term's product from those of the two terms before.
    """
    features, marks = stored(features.select("id", "features"), "features"), stored(marks.select("id", "y", "part"), "marks")
    width = features.agg(F.max(F.size("features"))).first()[0]
    if terms:
        one = stored(supports(terms[0]), "supports")
        if 8 * features.count() * width + 32 * one.count() + 16 * marks.count() <= LOCAL_BYTES:
            return _train_local(features, one, marks, width, terms[1] + 1, classes, hidden, epochs, rate, decay, dropout, patience, seed, True)
    held = stored(held, "supports")
    count = held.agg(F.max("s")).first()[0] + 1
    cells, arcs, marked = features.count() * width, held.count(), marks.count()
    if 8 * cells + 32 * arcs + 16 * marked <= LOCAL_BYTES:
        return _train_local(features, held, marks, width, count, classes, hidden, epochs, rate, decay, dropout, patience, seed)
    n = marks.where("part = 'train'").count()
    rng, adam, history = np.random.default_rng(seed), Adam(rate), []
    w0 = np.hstack([glorot(rng, width, hidden) for _ in range(count)])
    w1 = np.hstack([glorot(rng, hidden, classes) for _ in range(count)])

    def forward(drop: float, turn: int) -> tuple[DataFrame, DataFrame]:
        a, b = w0.copy(), w1.copy()

        def first(batch: pa.RecordBatch) -> np.ndarray:
            x = matrix_of(batch, "features")
            return (x * kept(numbers_of(batch, "id"), x.shape[1], drop, 2 * turn)) @ a

        def second(batch: pa.RecordBatch) -> np.ndarray:
            z = matrix_of(batch, "z")
            return (np.maximum(z, 0) * kept(numbers_of(batch, "id"), z.shape[1], drop, 2 * turn + 1)) @ b

        z0 = stored(_spread(held, mapped(features, "id", "z", first), "z", hidden), "layer")
        return z0, _spread(held, mapped(z0, "id", "z", second), "z", classes)

    def measured(z1: DataFrame) -> dict:
        rows = z1.join(marks, "id").withColumn("p", N.softmax(F.col("z")))
        hit = (N.argmax(F.col("p")) == F.col("y")).cast("double")
        loss = -F.ln(F.greatest(F.element_at("p", F.col("y").cast("int") + 1), F.lit(1e-300)))
        out = {}
        for row in rows.groupBy("part").agg(F.avg(loss).alias("loss"), F.avg(hit).alias("acc")).collect():
            name = "" if row["part"] == "train" else row["part"] + "_"
            out |= {f"{name}loss": row["loss"], f"{name}acc": row["acc"]}
        return out

    for turn in range(1, epochs + 1):
        z0, z1 = forward(dropout, turn)
        wanted = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == F.col("y"), 1.0).otherwise(0.0))
        error = F.zip_with(N.softmax(F.col("z")), wanted, lambda p, t: (p - t) / float(max(n, 1)))
        d1 = stored(z1.join(marks.where("part = 'train'"), "id").select("id", error.alias("d")), "error")
        middle = stored(_gathered(held, d1, "d", classes, count).join(z0, "id"), "gradient")
        b = w1.copy()

        def last(batch: pa.RecordBatch, drop=dropout, turn=turn) -> np.ndarray:
            z = matrix_of(batch, "z")
            x = np.maximum(z, 0) * kept(numbers_of(batch, "id"), z.shape[1], drop, 2 * turn + 1)
            return (x.T @ matrix_of(batch, "d")).reshape(-1)

        def below(batch: pa.RecordBatch, drop=dropout, turn=turn, b=b) -> np.ndarray:
            z = matrix_of(batch, "z")
            return (matrix_of(batch, "d") @ b.T) * kept(numbers_of(batch, "id"), z.shape[1], drop, 2 * turn + 1) * (z > 0)

        def start(batch: pa.RecordBatch, drop=dropout, turn=turn) -> np.ndarray:
            x = matrix_of(batch, "features")
            return ((x * kept(numbers_of(batch, "id"), x.shape[1], drop, 2 * turn)).T @ matrix_of(batch, "d")).reshape(-1)

        g1 = partition_sums(middle, last, w1.size).reshape(w1.shape)
        d0 = _gathered(held, mapped(middle, "id", "d", below), "d", hidden, count)
        g0 = partition_sums(d0.join(features, "id"), start, w0.size).reshape(w0.shape)
        adam.move([w0, w1], [g0 + decay * w0, g1])
        history.append({"epoch": turn - 1} | measured(forward(0.0, 0)[1] if dropout else z1))
        past = [h.get("val_loss") for h in history]
        if patience and len(past) > patience and past[-1] is not None and past[-1] > np.mean(past[-patience - 1 : -1]):
            break
    z0, z1 = forward(0.0, 0)
    relu = F.transform("z", lambda x: F.greatest(x, F.lit(0.0)))
    return z0.select("id", relu.alias("hidden")).join(z1.select("id", N.softmax(F.col("z")).alias("probs")), "id"), history


def _times(to: np.ndarray, by: np.ndarray, v: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """The product with the matrix of n rows whose entries are (to, by, v), sorted once; blocks of rows go over threads."""
    order = np.argsort(to, kind="stable")
    to, by, v = to[order], by[order], v[order, None]
    cut = np.flatnonzero(np.diff(to, prepend=-1))
    edges = np.unique(np.append(np.searchsorted(cut, np.arange(0, len(to), BLOCK)), len(cut)))
    ends = np.append(cut, len(to))
    pieces = [(to[cut[s:e]], by[ends[s] : ends[e]], v[ends[s] : ends[e]], cut[s:e] - ends[s]) for s, e in zip(edges, edges[1:])]

    def product(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, x.shape[1]))

        def run(piece: tuple) -> None:
            rows, near, values, starts = piece
            out[rows] = np.add.reduceat(values * x[near], starts, axis=0)

        if len(pieces) > 1:
            with ThreadPoolExecutor(min(8, os.cpu_count() or 1)) as pool:
                list(pool.map(run, pieces))
        elif pieces:
            run(pieces[0])
        return out

    return product


def _train_local(
    features: DataFrame, held: DataFrame, marks: DataFrame, width: int, count: int, classes: int, hidden: int, epochs: int, rate: float,
    decay: float, dropout: float, patience: int, seed: int, chebyshev: bool = False,
) -> tuple[DataFrame, list[dict]]:
    """``train_convolution`` on tables of checked size; ``chebyshev``: over the terms 0 to count - 1 of the one matrix held."""
    spark = features.sparkSession
    table = features.toArrow().sort_by("id")
    ids = table["id"].to_numpy()
    x = table["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
    place = lambda column: np.searchsorted(ids, column)
    known = lambda column: np.isin(column, ids)
    parts = held.toArrow()
    s, i, j, v = (parts[c].to_numpy() for c in ("s", "i", "j", "v"))
    space = np.union1d(ids, np.concatenate([i, j])) if chebyshev else ids  # a term's paths may lead through nodes without features
    seats = np.searchsorted(space, ids)
    pairs = []
    for k in range(1 if chebyshev else count):
        mine = (s == k) & np.isin(i, space) & np.isin(j, space)
        to, by = np.searchsorted(space, i[mine]), np.searchsorted(space, j[mine])
        pairs.append((_times(to, by, v[mine], len(space)), _times(by, to, v[mine], len(space))))
    told = marks.toArrow()
    mine = known(told["id"].to_numpy()) & told["y"].is_valid().to_numpy()
    at, y, part = place(told["id"].to_numpy()[mine]), told["y"].to_numpy()[mine].astype(int), np.array(told["part"].to_pylist())[mine]
    goal = np.zeros((len(ids), classes))
    goal[at, y] = 1
    train = np.zeros(len(ids), bool)
    train[at[part == "train"]] = True

    def wider(rows: np.ndarray) -> np.ndarray:
        if len(space) == len(ids):
            return rows
        out = np.zeros((len(space), rows.shape[1]))
        out[seats] = rows
        return out

    def spread(rows: np.ndarray, wide: int) -> np.ndarray:
        blocks = [rows[:, k * wide : (k + 1) * wide] for k in range(count)]
        if not chebyshev:
            return sum(times(np.ascontiguousarray(x)) for (times, _), x in zip(pairs, blocks))
        times, blocks = pairs[0][0], [wider(x) for x in blocks]
        one, two = blocks[-1], np.zeros((1, 1))  # Clenshaw's rule
        for x in blocks[-2:0:-1]:
            one, two = x + 2 * times(one) - two, one
        return (blocks[0] + times(one) - two)[seats]

    def gathered(rows: np.ndarray) -> np.ndarray:
        if not chebyshev:
            return np.hstack([back(rows) for _, back in pairs])
        back = pairs[0][1]
        terms = [wider(rows)]
        terms.append(back(terms[0]))
        while len(terms) < count:
            terms.append(2 * back(terms[-1]) - terms[-2])
        return np.hstack([x[seats] for x in terms])

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    rng, adam, history = np.random.default_rng(seed), Adam(rate), []
    w0 = np.hstack([glorot(rng, width, hidden) for _ in range(count)])
    w1 = np.hstack([glorot(rng, hidden, classes) for _ in range(count)])

    def forward(drop: float, turn: int) -> tuple[np.ndarray, ...]:
        a = x * kept(ids, width, drop, 2 * turn) if drop else x
        z0 = spread(a @ w0, hidden)
        mask = kept(ids, hidden, drop, 2 * turn + 1) if drop else np.ones_like(z0)
        b = np.maximum(z0, 0) * mask
        return a, z0, mask, b, spread(b @ w1, classes)

    def measured(p: np.ndarray) -> dict:
        out = {}
        for name in np.unique(part):
            rows, wanted = at[part == name], y[part == name]
            key = "" if name == "train" else name + "_"
            out |= {f"{key}loss": float(-np.log(np.maximum(p[rows, wanted], 1e-300)).mean()), f"{key}acc": float((p[rows].argmax(1) == wanted).mean())}
        return out

    for turn in range(1, epochs + 1):
        a, z0, mask, b, z1 = forward(dropout, turn)
        back = gathered(np.where(train[:, None], soft(z1) - goal, 0.0) / max(train.sum(), 1))
        down = gathered((back @ w1.T) * mask * (z0 > 0))
        adam.move([w0, w1], [a.T @ down + decay * w0, b.T @ back])
        history.append({"epoch": turn - 1} | measured(soft(forward(0.0, 0)[4] if dropout else z1)))
        past = [h.get("val_loss") for h in history]
        if patience and len(past) > patience and past[-1] is not None and past[-1] > np.mean(past[-patience - 1 : -1]):
            break
    _, z0, _, _, z1 = forward(0.0, 0)
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1)))
    return spark.createDataFrame(pa.table({"id": ids, "hidden": lists(np.maximum(z0, 0)), "probs": lists(soft(z1))})), history


def gcn(edges: DataFrame, features: DataFrame, marks: DataFrame, classes: int, **more) -> tuple[DataFrame, list[dict]]:
    """Convolutions over the renormalised adjacency; features are scaled to sum 1."""
    return _convolved([matrix.renormalised(matrix.matrix(edges), features.select("id"))], features, marks, classes, more)


def gcn_chebyshev(edges: DataFrame, features: DataFrame, marks: DataFrame, classes: int, order: int = 3, largest: float | None = None, **more) -> tuple[DataFrame, list[dict]]:
    """The same over the Chebyshev terms 0 to ``order`` of the Laplacian scaled by its largest eigenvalue, computed if not given."""
    nodes, a = features.select("id"), matrix.matrix(edges)
    if largest is None:
        lap = matrix.combined((1, matrix.identity(nodes)), (-1, matrix.symmetric_normalised(a)))
        largest = _largest(stored(lap, "laplacian"), nodes, 60) or 2.0
    scaled = stored(matrix.scaled_laplacian(a, nodes, largest), "scaled")
    return _convolved(matrix.chebyshev(scaled, nodes, order), features, marks, classes, more | ({"terms": (scaled, order)} if order > 1 else {}))


def _largest(a: DataFrame, nodes: DataFrame, steps: int) -> float:
    """``matrix.largest_eigenvalue``, in one process for a matrix of numbered nodes of at most ``LOCAL_BYTES``."""
    if a.schema["i"].dataType.typeName() not in ("long", "integer") or 32 * a.count() > LOCAL_BYTES:
        return matrix.largest_eigenvalue(a, nodes, steps)
    start = nodes.select("id", (F.lit(1.0) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x")).toArrow()
    cells = a.toArrow()
    i, j = cells["i"].to_numpy(), cells["j"].to_numpy()
    space = np.union1d(start["id"].to_numpy(), np.concatenate([i, j]))
    times = _times(np.searchsorted(space, i), np.searchsorted(space, j), cells["v"].to_numpy(), len(space))
    x, value = np.zeros((len(space), 1)), 0.0
    x[np.searchsorted(space, start["id"].to_numpy()), 0] = start["x"].to_numpy()
    for _ in range(steps):
        x = times(x)
        value = float(np.sqrt((x * x).sum()))
        if not value:
            return 0.0
        x /= value
    return value


def _convolved(matrices: list[DataFrame], features: DataFrame, marks: DataFrame, classes: int, more: dict) -> tuple[DataFrame, list[dict]]:
    scaled = features.select("id", N.l1_normalised(F.col("features")).alias("features"))
    return train_convolution(scaled, supports(*matrices), marks, classes, **more)


def one_hot(y: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == y, 1.0).otherwise(0.0))


def mlp(features: DataFrame, marks: DataFrame, classes: int, hidden: int = 16, dropout: float = 0.5, decay: float = 5e-4, epochs: int = 200, **more) -> tuple[DataFrame, DenseNet]:
    """Two dense layers on the features alone; returns (id, probs) and the network."""
    scaled = stored(features.select("id", N.l1_normalised(F.col("features")).alias("features")), "features")
    width = scaled.agg(F.max(F.size("features"))).first()[0]
    rows = stored(scaled.join(marks.where("part <> 'test'"), "id").select("id", "features", one_hot(F.col("y"), classes).alias("target"), (F.col("part") == "val").alias("valid")), "rows")
    net = fit_dense(rows, width, (hidden,), classes, "softmax", epochs, decay=decay, dropout=(dropout, dropout), **more)
    return net.predict(scaled), net


def edge_features(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (u, v, ...) with ``id`` and ``features``, the products of their ends' vectors place by place."""
    a, b = vectors.select(F.col("id").alias("u"), F.col("vec").alias("_a")), vectors.select(F.col("id").alias("v"), F.col("vec").alias("_b"))
    return pairs.join(a, "u").join(b, "v").select(F.xxhash64("u", "v").alias("id"), *pairs.columns, N.hadamard(F.col("_a"), F.col("_b")).alias("features"))


def link_prediction(
    pairs: DataFrame, vectors: DataFrame, hidden: tuple[int, ...] = (32, 32), dropout: float = 0.2, epochs: int = 10, validation: float = 0.2,
    patience: int = 1, rate: float = 0.01, seed: int = 42,
) -> tuple[DataFrame, DenseNet]:
    """(u, v, label, score) of test pairs and the network fitted to train pairs (u, v, label, part)."""
    rows = stored(edge_features(pairs.select("u", "v", "label", "part"), vectors), "pairs")
    width = rows.agg(F.max(F.size("features"))).first()[0]
    held = F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.lit(1 << 20)) < int(validation * (1 << 20))
    train = stored(rows.where("part = 'train'").select("id", "features", F.array(F.col("label").cast("double")).alias("target"), held.alias("valid")), "train")
    net = fit_dense(train, width, hidden, 1, "sigmoid", epochs, rate, dropout=(0.0, *(dropout,) * len(hidden)), patience=patience, seed=seed)
    test = rows.where("part = 'test'")
    scored = net.predict(test).select("id", F.col("probs")[0].alias("score")).dropDuplicates(["id"])
    return test.join(scored, "id").select("u", "v", "label", "score"), net


def rank_labels(vectors: DataFrame, labels: DataFrame, ratio: float = 0.5, epochs: int = 60, rate: float = 0.1, seed: int | None = 0) -> DataFrame:
    """(micro, macro, samples, weighted) F1 on the test part of ``labels`` (line_no, id, labels).

    One logistic model for each label, all fitted together on the train part; a test node gets
    as many best-scored labels as it truly has.
    """
    marked = stored(evaluate.permutation_split(labels, ratio, seed), "split")
    flat = marked.select("id", "part", F.explode("labels").alias("label"))
    book = stored(evaluate.label_index(flat), "labels")
    count = book.count()
    known = flat.join(book, "label")
    rows = stored(vectors.join(known.groupBy("id", "part").agg(F.collect_set("label_id").alias("own")), "id"), "rows")
    target = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.when(F.array_contains("own", k), 1.0).otherwise(0.0))
    width = rows.agg(F.max(F.size("vec"))).first()[0]
    train = stored(rows.where("part = 'train'").select(F.xxhash64("id").alias("id"), F.col("vec").alias("features"), target.alias("target"), F.lit(False).alias("valid")), "train")
    net = fit_dense(train, width, (), count, "sigmoid", epochs, rate, decay=1.0 / max(train.count(), 1))
    test = rows.where("part = 'test'")
    scores = net.predict(test.select("id", F.col("vec").alias("features"))).select("id", F.posexplode("probs").alias("label_id", "score")).join(book, "label_id").select("id", "label", "score")
    truth = known.where("part = 'test'").join(test.select("id").distinct(), "id", "left_semi").select("id", "label")
    return evaluate.f1_scores(truth, evaluate.top_ranked(scores, truth))


def principal_components(vectors: DataFrame, dim: int = 2) -> DataFrame:
    """(id, vec): projection on the ``dim`` strongest directions, each signed so that its largest weight is positive."""
    held = stored(vectors.select("id", "vec"), "vectors")
    width = held.agg(F.max(F.size("vec"))).first()[0]

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix_of(batch, "vec").astype(float)
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).reshape(-1)])

    found = partition_sums(held, moments, 1 + width + width * width)
    mean = found[1 : width + 1] / max(found[0], 1)
    _, axes = np.linalg.eigh(found[width + 1 :].reshape(width, width) / max(found[0], 1) - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :dim]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return mapped(held, "id", "vec", lambda batch: (matrix_of(batch, "vec") - mean) @ axes)


def sample_mask(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """``nodes`` (id) with ``mask``: whether ``index`` (idx) has the id."""
    listed = index.select(F.col("idx").alias("id")).distinct().withColumn("_in", F.lit(True))
    return nodes.join(listed, "id", "left").withColumn("mask", F.col("_in").isNotNull()).drop("_in")


def label_indicator(labels: DataFrame) -> DataFrame:
    """(id, y): the first label of a node, numbered by first appearance in ``line_no`` order."""
    seen = labels.select("line_no", "id", F.posexplode("labels").alias("pos", "label"))
    firsts = seen.groupBy("label").agg(F.min(F.struct("line_no", "pos")).alias("at"))
    book = firsts.select("label", (F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("y"))  # one row for each label
    return seen.where("pos = 0").join(book, "label").select("id", "y")
