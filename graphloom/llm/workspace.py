"""What the operators of this package share: tables kept in the shared folder, and filters of bounded size."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import BROADCAST_BYTES, size
from graphloom.plans.storage import cleanup, folder, issued, latest, stored

__all__ = ["cleanup", "folder", "issued", "keep", "latest", "prefilter", "ship", "slot", "without"]

#: Keys of ``prefilter`` fall into this many slots, so what it broadcasts is at most
#: this many integers (8 MB), whatever the size of the data.
PREFILTER_SLOTS = 1 << 20
#: Rows and bytes of an Arrow batch: whole texts go through Python workers, several of them beside each executor's heap.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def ship(*modules: str) -> None:
    """Pickle functions of these modules by value, so that executors needn't have the package."""
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def keep(df: DataFrame, name: str) -> DataFrame:
    """``stored``, with Arrow batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes while it is written."""
    conf, option, bytes_ = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before, bytes_before = conf.get(option), conf.get(bytes_)
    conf.set(option, str(min(int(before) if int(before) > 0 else BATCH_ROWS, BATCH_ROWS)))
    conf.set(bytes_, str(BATCH_BYTES))
    try:
        return stored(df, name)
    finally:
        conf.set(option, before)
        conf.set(bytes_, bytes_before)


def slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PREFILTER_SLOTS)).cast("int")


def prefilter(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` may be among ``keys``, found without a shuffle of ``rows``.

    Only slot numbers are broadcast, at most ``PREFILTER_SLOTS`` of them.  False
    positives stay in, so an exact join must follow; no match is lost.  Null keys go.
    """
    slots = keys.where(F.col(key).isNotNull()).select(slot(F.col(key)).alias("_slot")).distinct()
    return (
        rows.where(F.col(key).isNotNull())
        .withColumn("_slot", slot(F.col(key)))
        .join(F.broadcast(slots), "_slot", "left_semi")
        .drop("_slot")
    )


def without(rows: DataFrame, gone: DataFrame, key: str, *also: str) -> DataFrame:
    """Rows not in ``gone``, compared by ``key`` and the columns ``also``, nulls being equal there.

    ``gone`` is measured, and broadcast where it is small.  Else rows whose slot no key of ``gone`` has
    stay in their tasks; only the others, about as many as ``gone`` has, are shuffled for the exact
    comparison.  Rows of null ``key`` stay.
    """
    gone = keep(gone.where(F.col(key).isNotNull()).select(key, *also), "gone")
    same = F.col(f"r.{key}") == F.col(f"g.{key}")
    for name in also:
        same = same & F.col(f"r.{name}").eqNullSafe(F.col(f"g.{name}"))
    if size(gone) <= BROADCAST_BYTES:
        return rows.alias("r").join(F.broadcast(gone.alias("g")), same, "left_anti")
    slots = F.broadcast(gone.select(slot(F.col(key)).alias("_slot")).distinct())
    marked = rows.withColumn("_slot", F.when(F.col(key).isNotNull(), slot(F.col(key))))
    safe = marked.join(slots, "_slot", "left_anti").drop("_slot")
    doubtful = marked.join(slots, "_slot", "left_semi").drop("_slot").alias("r")
    return safe.unionByName(doubtful.join(gone.alias("g"), same, "left_anti"))
