"""From raw documents to packed training sequences, in stages that each end in a written table.

Stage 1 drops documents that the quality classifier rejects, stage 2 exact copies, stage 3 all
but one document of each near-duplicate group; stage 4 repeats or drops documents so that
sources meet their weights, and stage 5 packs what is left into sequences of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import dedup, mixing, neardup, packing, quality, tokens, workspace
from graphloom.operators.skew import join_totals

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, each row by its own score whatever its id."""
    placed = dedup.located(docs.select(*COLUMNS))
    judged = quality.score(placed, spark.read.parquet(f"{sf_dir}/labels.parquet"), also=("locator",))
    return dedup.without_places(placed, judged.where("not keep")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.deduplicated(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one of least id, null ids last, of equal ids the first by place.

    The join gets a number for each row, so rows of null id and of one id are compared as all others.
    """
    placed = dedup.located(docs.select(*COLUMNS))
    files = sorted(r[0] for r in placed.select("locator.file").distinct().collect())
    order = spark.createDataFrame(list(enumerate(files)), "_file long, _path string")
    numbered = placed.join(F.broadcast(order), F.col("locator.file") == F.col("_path")).withColumn("_row", F.col("_file") * (1 << 40) + F.col("locator.row"))
    found = neardup.join(numbered.select(F.col("_row").alias("doc_id"), "text")).where("links > 0")
    members = workspace.keep(found.select(F.col("doc_id").alias("_row"), "class_id").join(numbered.select("_row", "doc_id"), "_row"), "pipeline-near")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row"))
    classes = workspace.keep(members.groupBy("class_id").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "pipeline-classes")
    gone = join_totals(members, classes, ["class_id"], "n", members.count()).where("_row <> first._row")
    return workspace.without(numbered, gone, "_row").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.default_vocabulary(), capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: SQL can't express the classifier, MinHash and packing stages; tests/llm check each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = workspace.issued()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = workspace.keep(docs, f"pipeline-{k + 1}")
            workspace.cleanup(spark, before, but=workspace.latest())  # what the stage wrote on the way
    return docs
