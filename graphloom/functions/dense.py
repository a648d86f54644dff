"""Dense layers with weights on the driver: executors hold the rows and send sums of gradients.

What a step brings to the driver is as large as the weights, whatever the number of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16


def matrix_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of equally long arrays as one matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def numbers_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def lists_of(values: np.ndarray) -> pa.ListArray:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.reshape(-1).astype(np.float64)))


def mapped(rows: DataFrame, key: str, name: str, make: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(key, name): an array for each row, made of a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), lists_of(make(batch))], [key, name])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {name} array<double>")


def partition_sums(rows: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over ``rows`` of the vectors that ``add`` makes of batches: in each task, then by chunks of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-size // CHUNK) * CHUNK)
        for batch in batches:
            if batch.num_rows:
                total[:size] += add(batch)
        parts = total.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), lists_of(parts)], ["chunk", "g"])

    chunks = rows.mapInArrow(run, "chunk int, g array<double>").groupBy("chunk").agg(F.array(*[F.sum(F.col("g")[k]) for k in range(CHUNK)]).alias("g"))
    found = np.zeros(-(-size // CHUNK) * CHUNK)
    for row in chunks.collect():
        found[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = row["g"]
    return found[:size]


def kept(ids: np.ndarray, width: int, rate: float, seed: int) -> np.ndarray:
    """Dropout: 0 or 1 / (1 - rate) for each row and place, a function of id, place and seed alone."""
    if not rate:
        return np.ones((len(ids), width))
    big = np.uint64
    x = ids.astype(np.int64).astype(big)[:, None] * big(0x9E3779B97F4A7C15) + np.arange(width, dtype=big)[None] * big(0xBF58476D1CE4E5B9) + big(seed * 0x2545F4914F6CDD1D % 2**64)
    for shift in (31, 29, 32):
        x = (x ^ (x >> big(shift))) * big(0x94D049BB133111EB)
    return np.where((x >> big(11)).astype(np.float64) * 2.0**-53 >= rate, 1.0 / (1.0 - rate), 0.0)


def glorot(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    limit = np.sqrt(6.0 / (rows + columns))
    return rng.uniform(-limit, limit, (rows, columns))


@dataclass
class Adam:
    rate: float
    first: float = 0.9
    second: float = 0.999
    steps: int = 0
    state: dict = field(default_factory=dict)

    def move(self, weights: list[np.ndarray], gradients: list[np.ndarray]) -> None:
        """One step, in place."""
        self.steps += 1
        for k, (w, g) in enumerate(zip(weights, gradients)):
            m, v = self.state.get(k, (np.zeros_like(w), np.zeros_like(w)))
            m, v = self.first * m + (1 - self.first) * g, self.second * v + (1 - self.second) * g * g
            self.state[k] = (m, v)
            w -= self.rate * (m / (1 - self.first**self.steps)) / (np.sqrt(v / (1 - self.second**self.steps)) + 1e-8)


def split_like(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for w in like:
        out.append(flat[at : at + w.size].reshape(w.shape))
        at += w.size
    return out


def flattened(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.reshape(-1) for p in parts])


def activated(z: np.ndarray, kind: str) -> np.ndarray:
    """``sigmoid`` of every output, or ``softmax`` over a row's outputs."""
    if kind == "sigmoid":
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def entropy(p: np.ndarray, target: np.ndarray, kind: str) -> np.ndarray:
    safe = np.clip(p, 1e-12, 1 - 1e-12)
    losses = -target * np.log(safe)
    return (losses - (1 - target) * np.log(1 - safe) if kind == "sigmoid" else losses).sum(1)


@dataclass
class DenseNet:
    """Dense layers with relu between them; ``weights`` alternates matrices and biases."""

    weights: list[np.ndarray]
    kind: str
    dropout: tuple[float, ...]
    history: list[dict] = field(default_factory=list)

    def forward(self, x: np.ndarray, ids: np.ndarray | None = None, seed: int = 0) -> tuple[list, list, np.ndarray]:
        inputs, scales = [], []
        layers = len(self.weights) // 2
        for k in range(layers):
            scale = kept(ids, x.shape[1], self.dropout[k], seed * 64 + k) if ids is not None else 1.0
            x = x * scale
            inputs.append(x)
            scales.append(scale)
            x = x @ self.weights[2 * k] + self.weights[2 * k + 1]
            if k + 1 < layers:
                x = np.maximum(x, 0)
        return inputs, scales, activated(x, self.kind)

    def gradients(self, x: np.ndarray, target: np.ndarray, ids: np.ndarray, seed: int) -> tuple[list[np.ndarray], float]:
        inputs, scales, p = self.forward(x, ids, seed)
        delta, out = p - target, []
        for k in range(len(inputs) - 1, -1, -1):
            out = [inputs[k].T @ delta, delta.sum(0), *out]
            if k:
                delta = (delta @ self.weights[2 * k].T) * scales[k] * (inputs[k] > 0)
        return out, float(entropy(p, target, self.kind).sum())

    def predict(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """(key, probs) of rows (key, features)."""
        return mapped(rows.select(key, "features"), key, "probs", lambda batch: self.forward(matrix_of(batch, "features"))[2])


def fit_dense(
    rows: DataFrame, width: int, hidden: tuple[int, ...], outputs: int, kind: str = "softmax", epochs: int = 100, rate: float = 0.01,
    decay: float = 0.0, dropout: tuple[float, ...] | None = None, patience: int = 0, seed: int = 32,
) -> DenseNet:
    """Full-batch training on rows (id long, features, target array<double>, valid boolean).

    Rows that are ``valid`` only measure the loss; with ``patience`` training ends when that loss
    hasn't fallen for so many epochs.  ``decay`` pulls the matrices towards 0.
    """
    rng, sizes = np.random.default_rng(seed), (width, *hidden, outputs)
    weights = [part for a, b in zip(sizes, sizes[1:]) for part in (glorot(rng, a, b), np.zeros(b))]
    net, adam = DenseNet(weights, kind, dropout or (0.0,) * (len(sizes) - 1)), Adam(rate)
    size, best, since = sum(w.size for w in weights), np.inf, 0
    for epoch in range(epochs):

        def add(batch: pa.RecordBatch) -> np.ndarray:
            x, target, ids = matrix_of(batch, "features"), matrix_of(batch, "target"), numbers_of(batch, "id")
            held = numbers_of(batch, "valid").astype(bool)
            found, loss = net.gradients(x[~held], target[~held], ids[~held], epoch + 1)
            other = entropy(net.forward(x[held])[2], target[held], kind).sum() if held.any() else 0.0
            return np.concatenate([flattened(found), [loss, (~held).sum(), other, held.sum()]])

        total = partition_sums(rows, add, size + 4)
        loss, n, other, m = total[size:]
        steps = split_like(total[:size] / max(n, 1), weights)
        adam.move(weights, [g + decay * w if w.ndim == 2 else g for g, w in zip(steps, weights)])
        net.history.append({"epoch": epoch, "loss": loss / max(n, 1), "val_loss": other / max(m, 1)})
        since = 0 if other < best else since + 1
        best = min(best, other)
        if patience and m and since >= patience:
            break
    return net


cloudpickle.register_pickle_by_value(sys.modules[__name__])
