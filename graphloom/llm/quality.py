"""Quality of documents: a document classifier joined with host and path posteriors.

The classifier, a logistic regression on counts of a document's bytes and words, gives each
document's evidence.  Its mean over a host, shrunk to the global mean, is the host's
posterior; the mean over a path of the host, shrunk to the host's posterior, is the path's.
How strongly sparse sites are shrunk is estimated from the spread between sites (method of
moments).  The document's odds are its own likelihood ratio times the odds of its path,
taken without the document itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import words, workspace
from graphloom.operators.skew import join_totals

FEATURES = (
    "log_words", "distinct_words", "distinct_grams", "capitals", "digits", "symbols", "word_length",
    "newlines", "commas_stops", "one_word", "few_words", "capitals2", "symbols2", "distinct_words2", "distinct_grams2",
)
#: At most this many labelled documents are fitted; they fit into the driver at any corpus size.
LABELLED = 20_000
STRONGEST = 1e6


def _class_table() -> np.ndarray:
    """Columns: letters, capitals, digits, symbols, newlines, commas and stops."""
    table = np.zeros((6, 256), np.int8)
    byte = np.arange(256)
    upper, lower = (byte >= 65) & (byte <= 90), (byte >= 97) & (byte <= 122)
    table[0] = upper | lower | (byte >= 128)
    table[1] = upper
    table[2] = (byte >= 48) & (byte <= 57)
    table[3] = (byte > 32) & (byte < 127) & ~upper & ~lower & ~table[2].astype(bool) & ~np.isin(byte, [44, 46])
    table[4] = byte == 10
    table[5] = np.isin(byte, [44, 46])
    return table


def measures(texts: pa.Array, hasher: words.WordHasher, table: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offsets = words.buffers(texts)
    n = len(offsets) - 1
    counts = np.zeros((6, n))
    total, distinct, top, grams, distinct_grams = (np.zeros(n) for _ in range(5))
    for first, docs, hashes, owner in words.word_hashes(texts, hasher):
        span = slice(first, first + docs)
        s, e = offsets[first], offsets[first + docs]
        for k in range(6):  # sums over one run of documents at a time, else the sums of a batch take more than its text
            sums = np.concatenate([[0], np.cumsum(table[k][data[s:e]], dtype=np.int64)])
            counts[k, span] = np.diff(sums[offsets[first : first + docs + 1] - s])
        m = np.bincount(owner, minlength=docs)
        total[span] = m
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        if len(h):
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            at = np.flatnonzero(fresh)
            distinct[span] = np.bincount(o[at], minlength=docs)
            best = np.zeros(docs)
            np.maximum.at(best, o[at], np.diff(np.append(at, len(h))))
            top[span] = best
        starts = words.gram_sets(hashes, owner, docs, 5)[1]
        distinct_grams[span] = np.diff(starts)
        grams[span] = np.maximum(m - 4, (m > 0).astype(int))
    size = np.maximum(np.diff(offsets), 1)
    some, letters = np.maximum(total, 1), np.maximum(counts[0], 1)
    capital, symbol = counts[1] / letters, counts[3] / size
    varied, varied5 = distinct / np.sqrt(some * np.minimum(some, 1000)), distinct_grams / np.maximum(grams, 1)
    return np.stack([
        np.log1p(total), varied, varied5, capital, counts[2] / size, symbol, np.minimum(size / some, 40), counts[4] / size,
        counts[5] / size, top / some, total < 20, np.sqrt(capital), np.sqrt(symbol), varied**2, varied5**2,
    ], axis=1)


def evidence_features(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` (which must name its columns) and the array ``features`` for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = words.WordHasher(), _class_table()
        for batch in batches:
            found = measures(batch.column(batch.num_columns - 1), hasher, table)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "features"])

    chosen = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{schema}, features array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights and, last, the intercept, on the raw features; Newton steps on standardised ones."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - raw @ mean)


def _logit(p: Column) -> Column:
    return F.ln(p / (F.lit(1.0) - p))


def _strength(n: float, sites: float, squares: float, total: float, spread: float, rate: float) -> float:
    """Prior weight in documents: small where sites differ, large where they don't."""
    between = (spread - (sites - 1) * rate * (1 - rate)) / max(n - squares / max(n, 1), 1e-9) if sites > 1 else 0.0
    return float(min(max(rate * (1 - rate) / between - 1, 1.0), STRONGEST)) if between > 0 else STRONGEST


def score(
    docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
    threshold: float = 0.5, labelled: int = LABELLED, also: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, host, path, evidence, host_quality, path_quality, quality, keep and ``also`` for each row of ``docs``.

    ``labels`` has doc_id and quality (0 or 1); nulls there are ignored, several labels of an id are
    averaged.  At most ``labelled`` of them, the first by a hash of the id, are fitted.  Without labels
    of both kinds the evidence is even.  host defaults to ``source`` and path to ``lang``, for the
    documents have no address; with one, give ``host_of`` and ``path_of`` of it.  Nulls are sites of
    their own.  A null text counts as empty, texts of any length are read whole.  Rows of one id are
    all scored; an empty table gives no rows; further columns than ``also`` are ignored.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    own = [F.col("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), *also]
    seen = workspace.keep(evidence_features(docs, own), "quality-features")
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = seen.join(marks, "doc_id").select("doc_id", "features", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(labelled).collect()
    y = np.array([r["y"] for r in rows])
    if len(rows) and 0 < y.mean() < 1:
        weights, base = fit_logistic(np.array([r["features"] for r in rows]), y), float(y.mean())
    else:
        weights, base = np.zeros(len(FEATURES) + 1), 0.5
    logit = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1]):
        logit = logit + F.col("features")[k] * float(w)
    logit = F.least(F.greatest(logit, F.lit(-12.0)), F.lit(12.0))
    scored = seen.withColumn("evidence", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))

    return combined(scored, base, threshold, also)


def _site(*names: str) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("")).alias(f"_{name}") for name in names]


def combined(scored: DataFrame, base: float, threshold: float = 0.5, also: tuple[str, ...] = ()) -> DataFrame:
    """``score`` from (doc_id, host, path, evidence); ``base`` is the share of good documents that the evidence was fitted at.

    Sites are summed by partial aggregation; rows of large sites meet their sums in their own tasks.
    """
    keyed = scored.select("*", *_site("host", "path"))
    paths = workspace.keep(keyed.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("pn"), F.sum("evidence").alias("ps")), "quality-paths")
    hosts = paths.groupBy("_host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"), F.count(F.lit(1)).alias("sites"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count(F.lit(1)).alias("k"), F.sum(F.col("hn").cast("double") * F.col("hn")).alias("q"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("r")).first()
    total = float(whole["n"] or 0)
    rate = min(max((whole["s"] or 0.0) / total, 1e-6), 1 - 1e-6) if total else 0.5
    a = _strength(total, whole["k"], whole["q"] or 0.0, total, (whole["r"] or 0.0) - total * rate * rate, rate)
    hosts = workspace.keep(hosts.select("_host", "sites", ((F.col("hs") + a * rate) / (F.col("hn") + a)).alias("host_quality")), "quality-hosts")
    sites = workspace.keep(join_totals(paths, hosts, ["_host"], "sites", paths.count()).drop("sites"), "quality-sites")
    within = sites.agg(F.sum((F.col("ps") / F.col("pn") - F.col("host_quality")) ** 2 * F.col("pn")).alias("r"), F.count(F.lit(1)).alias("k"), F.sum(F.col("pn").cast("double") * F.col("pn")).alias("q")).first()
    b = _strength(total, within["k"], within["q"] or 0.0, total, within["r"] or 0.0, rate)

    joined = join_totals(keyed, sites, ["_host", "_path"], "pn", int(total))
    path_quality = (F.col("ps") - F.col("evidence") + F.col("host_quality") * b) / (F.col("pn") - 1 + b)
    path_quality = F.least(F.greatest(path_quality, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = _logit(F.col("evidence")) - float(np.log(base / (1 - base))) + _logit(F.col("path_quality"))
    return (
        joined.withColumn("path_quality", path_quality)
        .withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
        .select("doc_id", "host", "path", "evidence", "host_quality", "path_quality", "quality", (F.col("quality") >= threshold).alias("keep"), *also)
    )


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without a port; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """The first folder of an address, ``/`` where it has none; null where there is no host."""
    folder = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(/[^/?#]+)/", 1)
    return F.when(host_of(url).isNotNull(), F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")))


workspace.ship("graphloom.llm.words", __name__)
