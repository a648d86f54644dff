"""Near-duplicate documents: an n-gram Jaccard join by MinHash banding.

1. Each document becomes the set of its word n-grams.  Documents of equal sets are one class
   from here on, so copies are never compared with each other.
2. Band and row counts are the cheapest that find a pair at the threshold with the target
   recall.  Bands are shuffled as hashes; each bucket links its members to its least one, so
   a bucket of m members costs m links, and the links' components are the candidate groups.
3. A candidate group of at most ``TILE`` members is verified whole, on the full n-gram sets, and
   so settled at once.  A larger one is verified bucket by bucket or whole, whichever copies fewer
   sets: a chain of many small buckets costs each set its buckets, not the length of the chain.
   A pair that shares several buckets counts in the first.  Buckets and groups of more than ``TILE``
   members are cut into tiles by a hash, each pair of tiles being a piece of work of its own.
   A task counts the true links of its documents and returns one forest edge for each, not the pairs.
4. Forest edges of the larger groups are joined to classes by their components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import words, workspace
from graphloom.operators.skew import components, join_totals

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Members of a tile, n-grams of a tile, and columns of a block of the product of two tiles.
TILE, TILE_GRAMS, COLUMNS = 256, 1_000_000, 4096
SEED = 20_240_501


def banding(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows) within ``most`` hashes that reach ``recall`` at the threshold; the steepest such."""
    best = (most, 1)
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-hit)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _signatures(grams: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of each document; ``starts`` are of documents that have grams."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(starts), bands), np.uint64)
    for band in range(bands):
        h = np.full(len(starts), band + 1, np.uint64)
        for row in range(rows):
            k = band * rows + row
            h = words.mix(h ^ np.minimum.reduceat(grams * a[k] + b[k], starts))
        out[:, band] = h
    return out


def _keys(grams: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    """A 128-bit key of each document's set, into the rows of ``out``; 0 where it has no grams."""
    have = np.flatnonzero(np.diff(starts))
    if len(have):
        out[have, 0] = np.add.reduceat(words.mix(grams), starts[have])
        out[have, 1] = np.add.reduceat(words.mix(grams ^ np.uint64(SEED)), starts[have])


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, k1, k2 (a 128-bit key of the n-gram set), grams (its size) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = words.WordHasher()
        for batch in batches:
            size = batch.num_rows
            keys, counts = np.zeros((size, 2), np.uint64), np.zeros(size, np.int64)
            marks = np.zeros((size, bands), np.uint64)
            for first, docs_, hashes, owner in words.word_hashes(batch.column(1), hasher):
                grams, starts = words.gram_sets(hashes, owner, docs_, n)
                have = np.flatnonzero(np.diff(starts))
                counts[first : first + docs_] = np.diff(starts)
                if len(have):
                    at = starts[have]
                    _keys(grams, starts, keys[first : first + docs_])
                    marks[first + have] = _signatures(grams, at, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * bands, pa.int32()), pa.array(marks.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.array(counts), lists],
                ["doc_id", "k1", "k2", "grams", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(lambda batches: words.lean(run(batches)), "doc_id long, k1 long, k2 long, grams long, bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """rep and text to rep, the set's key and the sorted n-gram set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = words.WordHasher()
        for batch in batches:
            blobs: list[bytes] = []
            keys = np.zeros((batch.num_rows, 2), np.uint64)
            for first, docs_, hashes, owner in words.word_hashes(batch.column(1), hasher):
                grams, starts = words.gram_sets(hashes, owner, docs_, n)
                blobs += [grams[s:e].tobytes() for s, e in zip(starts, starts[1:])]
                _keys(grams, starts, keys[first : first + docs_])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(k.view(np.int64)) for k in keys.T.copy()), pa.array(blobs, pa.binary())], ["rep", "k1", "k2", "set"])

    return docs.select("rep", "text").mapInArrow(lambda batches: words.lean(run(batches)), "rep long, k1 long, k2 long, set binary")


def links_of(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets of ``a`` and ``b`` (or of ``a`` among themselves) reach the Jaccard threshold, exactly."""
    everything = a if b is None else a + b
    sizes = np.array([len(x) for x in everything], np.int64)
    owner = np.repeat(np.arange(len(everything)), sizes)
    grams = np.concatenate(everything)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    number = np.cumsum(fresh) - 1
    shared = (np.bincount(number) > 1)[number]  # a gram of one document only meets nothing
    owner, number = owner[shared], number[shared]
    _, number = np.unique(number, return_inverse=True)
    m, n = len(a), len(everything)
    common = np.zeros((m, m if b is None else n - m), np.float32)
    for lo in range(0, int(number.max(initial=-1)) + 1, COLUMNS):
        s, e = np.searchsorted(number, [lo, lo + COLUMNS])
        block = np.zeros((n, COLUMNS), np.float32)
        block[owner[s:e], number[s:e] - lo] = 1
        common += block[:m] @ (block if b is None else block[m:]).T
    inter = common.astype(np.int64)  # counts below 2**24 are exact in these floats
    left, right = sizes[:m, None], (sizes if b is None else sizes[m:])[None, :]
    # compared in integers where the threshold has few digits: |A and B| * 10**6 >= t * 10**6 * |A or B|
    out = inter * 1_000_000 >= round(threshold * 1_000_000) * (left + right - inter)
    if b is None:
        np.fill_diagonal(out, False)
    return out


def _forest(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> dict[int, int]:
    """A parent for each linked node such that the edges connect what the links connect."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in np.flatnonzero(links.any(1)):
        root = find(int(rows[i]))
        for j in columns[links[i]].tolist():
            other = find(j)
            if other != root:
                root, other = min(root, other), max(root, other)
                parent[other] = root
    return {x: find(x) for x in list(parent)}


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first ``keys`` columns, from batches sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _earlier(a: list, b: list, band: int) -> np.ndarray:
    """Which pairs of a and b, lists of each set's buckets (spot, band, ...) of at least two members, meet in a band before ``band``."""
    tables = []
    for rows in (a, b):
        spot, there = np.zeros((len(rows), band), np.int64), np.zeros((len(rows), band), bool)
        for r, met in enumerate(rows):
            for one in met:
                if one["band"] < band:
                    spot[r, one["band"]], there[r, one["band"]] = one["spot"], True
        tables.append((spot, there))
    (x, in_a), (y, in_b) = tables
    out = np.zeros((len(a), len(b)), bool)
    for k in range(band):
        out |= (x[:, k, None] == y[None, :, k]) & in_a[:, k, None] & in_b[None, :, k]
    return out


def _verify(tiles: DataFrame, threshold: float) -> DataFrame:
    """node, parent, links, class_id for rows (spot, band, i, j, side, node, rep, copies, whole, set, met) sorted by the first six.

    band: the bucket's band, or -1 for a candidate group.  met: the set's other buckets, for the later bands.
    class_id is null unless the tile holds a whole group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 4):
            _, band, i, j = group[0][:4]
            a = [r for r in group if r[4] == 0]
            b = None if i == j else [r for r in group if r[4] == 1]
            if not a or (b is None and len(a) < 2) or (b is not None and not b):
                continue
            sets = lambda rows: [np.frombuffer(r[9], np.uint64) for r in rows]
            links = links_of(sets(a), None if b is None else sets(b), threshold)
            other = a if b is None else b
            if band > 0:
                links &= ~_earlier([r[10] for r in a], [r[10] for r in other], band)
            ids, ids_b = np.array([r[5] for r in a]), np.array([r[5] for r in other])
            count = dict(zip(ids.tolist(), (links @ np.array([r[7] for r in other], np.int64)).tolist()))
            if b is not None:
                count |= dict(zip(ids_b.tolist(), (np.array([r[7] for r in a], np.int64) @ links).tolist()))
            parents = _forest(links, ids, ids_b)
            nodes = sorted(parents)
            if nodes:
                least: dict[int, int] = {}
                if group[0][8]:
                    for r in a:
                        if r[5] in parents:
                            root = parents[r[5]]
                            least[root] = min(least.get(root, r[6]), r[6])
                columns = [nodes, [parents[x] for x in nodes], [count[x] for x in nodes], [least.get(parents[x]) for x in nodes]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "parent", "links", "class_id"])

    return tiles.mapInArrow(lambda batches: words.lean(run(batches)), "node long, parent long, links long, class_id long")


def _pieces(members: str, grams: str) -> Column:
    """Tiles of a group of so many members and n-grams."""
    return F.greatest(F.ceil(F.col(members) / TILE), F.ceil(F.col(grams) / TILE_GRAMS)).cast("int")


def _spots(classes: DataFrame, buckets: DataFrame, candidates: DataFrame) -> DataFrame:
    """node and its places of verification, an array of (spot, band, tiles): its candidate group, or its buckets of at least two members."""
    members = workspace.keep(candidates.join(classes.select("node", "grams"), "node"), "neardup-members")
    sized = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("grams").alias("g"))
    sizes = workspace.keep(sized.withColumn("tiles", _pieces("m", "g")), "neardup-sizes")
    placed = join_totals(members, sizes, ["root"], "m", members.count())
    large = sizes.where("tiles > 1")
    by_group = F.array(F.struct(F.col("root").alias("spot"), F.lit(-1).alias("band"), "tiles"))
    if large.isEmpty():
        return placed.select("node", by_group.alias("spots"))
    inside = placed.where("tiles > 1").select("node", "root", "grams")
    met = workspace.keep(buckets.join(inside, "node"), "neardup-met")
    filled = met.groupBy("bucket").agg(F.first("root").alias("root"), F.first("band").alias("band"), F.count(F.lit(1)).alias("bm"), F.sum("grams").alias("bg")).where("bm > 1")
    filled = workspace.keep(filled.withColumn("btiles", _pieces("bm", "bg")), "neardup-filled")
    costs = filled.groupBy("root").agg(F.sum(F.col("bm") * F.col("btiles")).alias("cost"))
    choice = workspace.keep(large.join(costs, "root", "left").select("root", "m", "tiles", (F.col("cost") < F.col("m") * F.col("tiles")).alias("split")), "neardup-choice")
    apart = join_totals(met.select("node", "root", "bucket"), choice.where("split").select("root", "m"), ["root"], "m", met.count()).select("node", "bucket")
    spread = join_totals(apart, filled.select("bucket", "band", "bm", "btiles"), ["bucket"], "bm", met.count())
    spread = spread.groupBy("node").agg(F.collect_list(F.struct(F.col("bucket").alias("spot"), "band", F.col("btiles").alias("tiles"))).alias("spots"))  # at most one for each band
    whole = sizes.join(choice.where("split").select("root"), "root", "left_anti")
    whole = join_totals(members.select("node", "root"), workspace.keep(whole, "neardup-whole"), ["root"], "m", members.count())
    return whole.select("node", by_group.alias("spots")).unionByName(spread)


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, links, representative: a row for each row of ``docs``.

    links: how many other rows have an n-gram set of at least ``threshold`` Jaccard similarity,
    exact copies included.  class_id: the least doc_id that such links lead to, the own one if
    there are none.  representative: the least doc_id of an equal n-gram set.

    Words are runs other than space and 0x09-0x0D, as they stand.  A text of 1 to n-1 words has one
    gram, of all its words; a null or empty text has none and links to nothing, nor do rows of null
    id, whose class is null.  Rows of one id and equal sets count as copies, those of one id and other
    sets have links and classes of their own; other columns are ignored; an empty table gives no rows.
    """
    bands, rows = banding(threshold, recall)
    signed = workspace.keep(signatures(docs, n, bands, rows), "neardup-signatures")
    useful = signed.where("grams > 0 and doc_id is not null")
    sets_of = useful.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    # a number for each set, fixed by writing it, since two sets of one id may have the same rep
    classes = workspace.keep(sets_of.withColumn("node", F.monotonically_increasing_id()), "neardup-classes")
    buckets = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    roots = workspace.keep(buckets.groupBy("bucket").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("m")).where("m > 1"), "neardup-buckets")
    stars = join_totals(buckets.select("node", "bucket"), roots, ["bucket"], "m", classes.count() * bands).where("node <> root")
    candidates = components(stars.select(F.col("node").alias("u"), F.col("root").alias("v")), "neardup-candidates")

    spots = _spots(classes, buckets, candidates)
    placed = workspace.keep(spots.join(classes.select("node", "rep", "k1", "k2", "copies"), "node"), "neardup-placed")
    # Texts of candidates only: a prefilter of bounded size, then an exact join on the id.
    ids = placed.select(F.col("rep").alias("doc_id"))
    found = workspace.prefilter(docs.select("doc_id", "text"), ids, "doc_id")
    texts = found.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text")
    sets = _sets(texts, n).groupBy("rep", "k1", "k2").agg(F.first("set").alias("set"))
    tile = F.pmod(F.xxhash64("node"), F.col("s.tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("s.tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j"), (F.col("tile") > t).cast("int").alias("side")))
    known = placed.join(sets, ["rep", "k1", "k2"]).withColumn("s", F.explode("spots")).withColumn("tile", tile)
    whole = (F.col("s.band") < 0) & (F.col("s.tiles") == 1)
    met = F.when(F.col("s.band") > 0, F.col("spots"))
    spread = known.select("s", "node", "rep", "copies", whole.alias("whole"), "set", met.alias("met"), F.explode(pairs).alias("p"))
    # the pairs of tiles of one spot go to tasks in turn, so that a large spot fills all of them alike
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = (F.col("p.j") * (F.col("p.j") + 1) / 2).cast("long") + F.col("p.i")
    place = F.pmod(F.xxhash64("s.spot", "s.band") + turn, F.lit(parts)).cast("int")
    spread = spread.select("s.spot", "s.band", "p.i", "p.j", "p.side", "node", "rep", "copies", "whole", "set", "met", place.alias("place"))
    dealt = spread.repartitionById(parts, "place").drop("place").sortWithinPartitions("spot", "band", "i", "j", "side", "node")
    verified = workspace.keep(_verify(dealt, threshold).repartition("node"), "neardup-links")  # few rows of many tasks: few files

    linked = verified.where("class_id is not null").select("node", "class_id", "links")
    open_ = verified.where("class_id is null")
    if not open_.isEmpty():
        final = components(open_.select(F.col("node").alias("u"), F.col("parent").alias("v")), "neardup-classes-of")
        named = workspace.keep(final.join(classes.select("node", "rep"), "node"), "neardup-named")
        least = workspace.keep(named.groupBy("root").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("n")), "neardup-least")
        named = join_totals(named, least, ["root"], "n", named.count()).select("node", "class_id")
        linked = linked.unionByName(named.join(open_.groupBy("node").agg(F.sum("links").alias("links")), "node"))
    told = classes.select("node", "k1", "k2", "rep", "copies").join(linked, "node", "left")
    told = told.select("k1", "k2", "rep", "copies", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"))
    told = workspace.keep(told, "neardup-told")
    plain = signed.where("grams = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.col("doc_id").alias("representative"))
    rows = join_totals(useful.select("doc_id", "k1", "k2"), told, ["k1", "k2"], "copies", useful.count())
    return rows.select("doc_id", "class_id", "links", F.col("rep").alias("representative")).unionByName(plain)


workspace.ship("graphloom.llm.words", __name__)
