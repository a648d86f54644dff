"""Exact deduplication with streaming state, in DataFrame and Structured Streaming operations only.

The state of the stream is a disk-backed table keyed by the digest of the normalised text.  It
never expires and holds the smallest document id, where that document's content lies, and how
many rows had the digest.  Digests that were hit again are then checked on
the full texts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import workspace

SPACE = r"[\x20\x09-\x0D]+"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Files of digests in one micro-batch; documents for each store of a state that isn't kept.
FILES_A_BATCH, ROWS_A_STORE = 1000, 25_000
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # else every store of an executor stays open, with memory of its own beside the heap, until long after the query
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # else each of many small stores reserves megabytes of disk for its logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normal(text: Column) -> Column:
    """Each run of space and 0x09-0x0D as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def update_state(stream: DataFrame) -> DataFrame:
    """The stateful part, for a stream of (digest, run, doc_id, locator): digest, first, copies.

    first is the least (run, doc_id, locator), null ids last.  There is no watermark, so state is
    kept for as long as the query's checkpoint.  Run it in update mode.
    """
    order = F.struct("run", F.col("doc_id").isNull().alias("unknown"), "doc_id", "locator")
    return stream.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))


def _through_state(spark: SparkSession, schema: T.StructType, place: str, files: int, parts: int) -> DataFrame:
    """Send what is new below ``place``/digests through the state kept there, in ``parts`` stores, ``files`` files a batch; the state after the last."""
    settings = _SETTINGS | {"spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        state = update_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{place}/digests/*"))

        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/changes/batch={number}/rows")

        query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{place}/progress").foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    versions = spark.read.schema(T.StructType([*state.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{place}/changes/*/rows")
    return versions.groupBy("digest").agg(F.max_by(F.struct("first", "copies"), "batch").alias("s")).select("digest", "s.first", "s.copies")


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``locator``, the file and row where Spark reads each text; one that doesn't come from files is written first."""
    try:
        docs.select("_metadata.row_index").schema
    except AnalysisException:
        docs = workspace.keep(docs, "dedup-documents")
    return docs.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))


def without_places(placed: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of a located table whose ``locator`` isn't in ``gone``."""
    place = F.xxhash64("locator.file", "locator.row").alias("_place")
    return workspace.without(placed.select("*", place), gone.select("locator", place), "_place", "locator").drop("_place")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``dedup``."""
    placed = located(docs)  # once: rows that don't come from files get new places each time
    return without_places(placed, _decided(placed).where("not kept")).select(*docs.columns)


def dedup(docs: DataFrame, state: str | None = None, files: int = FILES_A_BATCH, hex_digits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and the content ``locator``; a row for each row.

    Equal: the same after each run of white space became one space, null being empty.  Of equal
    texts the smallest doc_id stays.  Rows of one id and text are told apart by their place, the
    first of them stays; a null id is the largest.  An empty table gives no rows; other columns
    are ignored.

    ``state``: a folder below which the state is kept for later calls with the same folder, each with
    new documents.  Documents of earlier calls come before those of later ones; sizes count all calls
    so far, and the files of earlier calls must still be there, for their texts are read again on hits.
    Digests go through the state ``files`` files at a time.  ``hex_digits``: how much of the SHA-256 is the
    state's key.  Where texts of one key differ, its rows are grouped by text.
    """
    return _decided(located(docs.select("doc_id", "text")), state, files, hex_digits)


def _decided(docs: DataFrame, place: str | None = None, files: int = FILES_A_BATCH, hex_digits: int = 64) -> DataFrame:
    """``dedup`` of a table that has its ``locator``."""
    spark = docs.sparkSession
    text = normal(F.col("text"))
    parts, once = int(spark.conf.get("spark.sql.shuffle.partitions")), not place
    place = place or workspace.folder(spark, "dedup")
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/digests")
    disk = base.getFileSystem(spark._jsc.hadoopConfiguration())
    run = len(disk.listStatus(base)) if disk.exists(base) else 0
    sha = F.sha2(text, 256)
    mine = docs.select("doc_id", sha.alias("sha"), F.substring(sha, 1, hex_digits).alias("digest"), F.lit(run).alias("run"), "locator")
    mine.write.parquet(f"{place}/digests/run={run:06d}-")
    digests = spark.read.schema(mine.schema).parquet(f"{place}/digests/run={run:06d}-")
    if once:  # every store takes memory; a state that is kept must be ready for larger tables
        parts = min(parts, max(8, digests.count() // ROWS_A_STORE))
    whole = workspace.keep(_through_state(spark, mine.schema, place, files, parts), "dedup-state")
    hits = whole.where("copies > 1")

    # Full bytes on hits: the hit rows' texts by digest and text.  The aggregate keeps one row for each
    # text and task before the shuffle.  A filter of bounded size keeps most other documents in their
    # tasks (beyond some million hits it lets most through, and texts are shuffled once); the join is exact.
    hit_rows = digests.join(hits.select("digest"), "digest", "left_semi")
    order = F.struct("run", F.col("doc_id").isNull().alias("unknown"), "doc_id", "locator")
    texts = docs.select("doc_id", F.lit(run).alias("run"), "locator", F.lit(1).cast("long").alias("n"), F.coalesce("doc_id", F.lit(0)).alias("id"), text.alias("whole"))
    texts = workspace.prefilter(texts, hit_rows.select(F.coalesce("doc_id", F.lit(0)).alias("id")), "id").drop("id")
    if run:  # of earlier calls, the first row of each text
        earlier = spark.read.schema(mine.schema).parquet(f"{place}/digests/*").where(F.col("run") < run).join(hit_rows.select("digest").distinct(), "digest", "left_semi")
        old = workspace.keep(earlier.groupBy("digest", "sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).select("first.*", "n"), "dedup-earlier")
        paths = [r[0] for r in old.select("locator.file").distinct().collect()]  # as many as there are files
        if paths:
            found = spark.read.parquet(*paths).select("text", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))
            texts = texts.unionByName(found.join(old, "locator").select("doc_id", "run", "locator", "n", normal(F.col("text")).alias("whole")))
    texts = texts.withColumn("digest", F.substring(F.sha2("whole", 256), 1, hex_digits))
    distinct = texts.groupBy("digest", "whole").agg(F.count(F.lit(1)).alias("rows")).select("digest").groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    clashes = workspace.keep(distinct.where("texts > 1").join(hits, "digest", "left_semi").select("digest"), "dedup-clashes")
    one = digests.join(whole, "digest")
    if not clashes.isEmpty():
        one = one.join(clashes, "digest", "left_anti")
        apart = texts.join(clashes, "digest")
        groups = apart.groupBy("digest", "whole").agg(F.min(order).alias("first"), F.sum("n").alias("copies"))
        told = apart.where(F.col("run") == run).join(groups, ["digest", "whole"]).select("doc_id", "locator", F.sha2("whole", 256).alias("sha"), "first", "copies")
        one = one.select("doc_id", "locator", "sha", "first", "copies").unionByName(told)
    here = (F.col("first.run") == run) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("locator").eqNullSafe(F.col("first.locator"))
    return one.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("copies").cast("long").alias("group_size"), here.alias("kept"), F.col("sha").alias("text_sha256"), "locator")


ORACLE = r"""
    with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
    g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n.t) as text_sha256 from n join g on n.t = g.t
"""
