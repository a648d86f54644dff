"""Best-fit packing of pieces into sequences by the linear grouping scheme.

What must be decided jointly is decided on the histogram of lengths alone, at most
``capacity`` numbers however large the corpus:

1. Large lengths, sorted, are split into groups of equal cardinality; within a group all
   count as the group's longest.
2. For these few sizes the best configurations of a sequence are found by column generation
   (Gilmore and Gomory 1961; Fernandez de la Vega and Lueker 1981); the rounded-down plan is
   opened, what it leaves over is placed by best fit.
3. Actual pieces take the slots of their group.  Runs of sequences that hold equal lengths
   stay together as one interval, so this too needs no more than a few thousand records.
4. Small pieces go, longest first, to the fullest sequences they fit, interval by interval.

The resulting records say where the r-th piece of each length goes; each piece looks its
own up.  An interval's room falls below half whenever it is touched, so at most
log2(capacity) records arise from each: the table that is broadcast is bounded by the
capacity and number of groups, never by the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import tokenize, workspace


@dataclass(frozen=True)
class Run:
    """Pieces first..first+count-1 of a length go to sequences from ``opened`` on, ``each`` to one."""

    length: int
    first: int
    count: int
    opened: int
    each: int


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, pieces of each size) of a linear optimum, rounded down."""
    k = len(sizes)
    patterns = np.diag([max(1, capacity // s) for s in sizes]).astype(float)
    demand, weights = np.array(counts, float), np.array(sizes)
    for _ in range(60 * k):
        inverse = np.linalg.inv(patterns)
        amounts = inverse @ demand
        price = inverse.T @ np.ones(k)
        best, value = _knapsack(weights, price, capacity)
        if value <= 1 + 1e-4:  # within a ten-thousandth of the linear optimum
            break
        direction = inverse @ best
        usable = direction > 1e-9
        if not usable.any():
            break
        ratio = np.full(k, np.inf)
        ratio[usable] = np.maximum(amounts[usable], 0) / direction[usable]
        patterns[:, int(np.argmin(ratio))] = best
    amounts = np.linalg.inv(patterns) @ demand
    plan = [(int(np.floor(x + 1e-9)), [int(v) for v in patterns[:, j]]) for j, x in enumerate(amounts)]
    return [(times, pattern) for times, pattern in plan if times > 0 and sum(pattern)]


def _knapsack(weights: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The dearest pattern that fits, any number of each size."""
    worth = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(int(weights.min()), capacity + 1):
        fits = weights <= room
        gains = np.where(fits, price + worth[np.where(fits, room - weights, 0)], -1)
        j = int(np.argmax(gains))
        if gains[j] > worth[room - 1] + 1e-12:
            worth[room], taken[room] = gains[j], j
        else:
            worth[room] = worth[room - 1]
    pattern, room = np.zeros(len(weights)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= weights[taken[room]]
    return pattern, worth[capacity]


class _Open:
    """Sequences by room left, as intervals of equal content."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.n = capacity, 0
        self.by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.runs: list[Run] = []

    def new(self, count: int) -> int:
        self.n += count
        return self.n - count

    def leave(self, opened: int, count: int, room: int) -> None:
        if room > 0 and count > 0:
            self.by_room[room].append((opened, count))

    def best_fit(self, length: int, first: int, count: int) -> None:
        """Pieces of one length into the least room that takes them, then into new sequences."""
        for room in sorted(r for r in self.by_room if r >= length):
            each = room // length
            while count and self.by_room[room]:
                opened, width = self.by_room[room].pop()
                full = min(width, count // each)
                if full:
                    self.runs.append(Run(length, first, full * each, opened, each))
                    self.leave(opened, full, room - each * length)
                    first, count = first + full * each, count - full * each
                if full < width and count:  # fewer pieces are left than one sequence takes
                    self.runs.append(Run(length, first, count, opened + full, count))
                    self.leave(opened + full, 1, room - count * length)
                    self.leave(opened + full + 1, width - full - 1, room)
                    count = 0
                elif full < width:
                    self.leave(opened + full, width - full, room)
            if not self.by_room[room]:
                del self.by_room[room]
            if not count:
                return
        each = self.capacity // length
        for width, per in ((count // each, each), (1, count % each)):
            if width and per:
                opened = self.new(width)
                self.runs.append(Run(length, first, width * per, opened, per))
                self.leave(opened, width, self.capacity - per * length)
                first += width * per


def plan(histogram: dict[int, int], capacity: int, groups: int = 24, small: int = 8) -> tuple[list[Run], int]:
    """Where the pieces of each length go, and the number of sequences."""
    book = _Open(capacity)
    large = sorted((x for x in histogram if x > capacity // small), reverse=True)
    done = dict.fromkeys(histogram, 0)
    total = sum(histogram[x] for x in large)
    if total:
        bounds = [total * k // groups for k in range(groups + 1)]
        ranks, at = [], 0
        for x in large:  # the pieces of a length hold the ranks at..at+count-1, longest first
            ranks.append((at, x))
            at += histogram[x]
        begins = [r for r, _ in ranks]

        def length_at(rank: int) -> int:
            return ranks[np.searchsorted(begins, rank, side="right") - 1][1]

        cut = [(lo, hi) for lo, hi in zip(bounds, bounds[1:]) if hi > lo]
        merged: dict[int, list[list[int]]] = {}
        for lo, hi in cut:  # groups of one rounded size are one size to the optimiser
            merged.setdefault(length_at(lo), []).append([lo, hi])
        sizes = list(merged)
        spans = [[parts[0][0], parts[-1][1]] for parts in merged.values()]
        for times, pattern in configurations(sizes, [hi - lo for lo, hi in spans], capacity):
            slots: list[int] = []
            for j, number in enumerate(pattern):
                for _ in range(number):
                    if spans[j][1] - spans[j][0] >= times:
                        slots.append(spans[j][0])
                        spans[j][0] += times
            if slots:
                _fill(book, slots, times, ranks, begins, histogram, done)
        for lo, hi in spans:  # what rounding down left over
            while lo < hi:
                i = int(np.searchsorted(begins, lo, side="right")) - 1
                begin, x = ranks[i]
                count = min(hi, begin + histogram[x]) - lo
                book.best_fit(x, lo - begin, count)
                lo += count
    for x in sorted((x for x in histogram if x <= capacity // small), reverse=True):
        book.best_fit(x, 0, histogram[x])
    return book.runs, book.n


def _fill(book: _Open, slots: list[int], times: int, ranks, begins, histogram, done) -> None:
    """Open ``times`` sequences; sequence b takes rank slots[s] + b for each slot s."""
    opened = book.new(times)
    used = np.zeros(1, np.int64)
    edges = {0, times}
    pieces = []
    for slot in slots:
        b = 0
        while b < times:
            i = int(np.searchsorted(begins, slot + b, side="right")) - 1
            begin, x = ranks[i]
            width = min(times - b, begin + histogram[x] - slot - b)
            book.runs.append(Run(x, slot + b - begin, width, opened + b, 1))
            pieces.append((b, b + width, x))
            edges |= {b, b + width}
            b += width
    marks = sorted(edges)
    at = {m: k for k, m in enumerate(marks)}
    used = np.zeros(len(marks), np.int64)
    for lo, hi, x in pieces:
        used[at[lo]] += x
        used[at[hi]] -= x
    for lo, hi, filled in zip(marks, marks[1:], np.cumsum(used)):
        book.leave(opened + lo, hi - lo, book.capacity - int(filled))


def place(pieces: DataFrame, capacity: int, groups: int = 24, small: int = 8) -> DataFrame:
    """``sequence_id`` and ``offset`` for rows with ``part``, ``length`` and ``seat``.

    (part, length, seat) must tell rows apart and seats count from 0 in each part and length.
    Lengths lie in 1..capacity.  Empty input gives an empty result.
    """
    tally = workspace.keep(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-tally")
    histogram = {r[0]: r[1] for r in tally.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity, groups, small)
    runs.sort(key=lambda r: (r.length, r.first))
    lengths = np.array([r.length for r in runs], np.int64)
    firsts, opened, each = (np.array([getattr(r, k) for r in runs], np.int64) for k in ("first", "opened", "each"))
    table = pieces.sparkSession.sparkContext.broadcast((lengths, firsts, opened, each))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, opened, each = table.value
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            length = columns.pop("length").to_numpy(zero_copy_only=False)
            rank = columns.pop("_rank").to_numpy(zero_copy_only=False)
            at = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = length == x
                lo, hi = np.searchsorted(lengths, [x, x + 1])
                at[mine] = lo + np.searchsorted(firsts[lo:hi], rank[mine], side="right") - 1
            sequence = opened[at] + (rank - firsts[at]) // each[at]
            columns |= {"length": pa.array(length, pa.int64()), "sequence_id": pa.array(sequence, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kept = [c for c in pieces.columns if c not in ("part", "seat")]
    # counts by partition and length grow with the table, so they must not be broadcast
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).select(*kept, (F.col("_base") + F.col("seat")).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*[c for c in kept if c != "length"]).schema) + ", length long, sequence_id long"
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.mapInArrow(look_up, schema).select(
        *kept, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset")
    )


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, groups: int = 24) -> DataFrame:
    """Pack all documents: one row for each piece with its sequence and place in it.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty text is one
    piece of just the end id.  A document longer than ``capacity`` is cut into full pieces and a
    last shorter one.  Repeated rows are packed as often as they occur; ties between equal
    lengths are broken by partition and position; other columns are ignored; an empty table gives none.
    """
    found = workspace.keep(tokenize.token_pieces(docs, vocabulary, capacity, end_id).drop("ids"), "pack-pieces")
    return place(found, capacity, groups)


def sequences(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, groups: int = 24) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian unsigned 32-bit), length."""
    found = workspace.keep(tokenize.token_pieces(docs, vocabulary, capacity, end_id, with_ids=True), "pack-pieces")
    slots = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` pieces
    return (
        place(found, capacity, groups)
        .groupBy("sequence_id")
        .agg(slots.alias("_s"), F.sum("length").alias("length"))
        .select("sequence_id", F.expr("aggregate(_s, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), "length")
    )
