"""The queries of this package and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat, dedup, licences, mixing, neardup, packing, pii, planes, quality, search, tokens, workspace


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokens.default_vocabulary(), capacity=4096, end_id=1)


def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.join(_table(spark, folder, "documents"))


def token_planes(spark: SparkSession, folder: str) -> DataFrame:
    path = workspace.folder(spark, "planes")
    return planes.read(planes.write(_table(spark, folder, "documents"), path, tokens.default_vocabulary(), end_id=2), path)


def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def preference_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.spelled(chat.format_pairs(chat.neighbours(_table(spark, folder, "conversations"))))


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.dedup(_table(spark, folder, "documents")).drop("locator")


def pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """The test tables are invented, so the key is no secret; set ``spark.graphloom.pseudonymKey`` elsewhere."""
    return pii.pseudonymise(_table(spark, folder, "documents"), spark.conf.get("spark.graphloom.pseudonymKey", "public test key"))


def licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": best_fit_packing,
        "op2_jaccard_join": jaccard_join,
        "op3_token_planes": token_planes,
        "op4_source_mixing": source_mixing,
        "op5_exact_top_k": exact_top_k,
        "op6_quality_classifier": quality_classifier,
        "op7_preference_formatting": preference_formatting,
        "op8_exact_dedup": exact_dedup,
        "op9_pii_pseudonyms": pii_pseudonyms,
        "op10_licence_scan": licence_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_source_mixing": mixing.oracle(),
        "op5_exact_top_k": search.ORACLE,
        "op7_preference_formatting": chat.ORACLE,
        "op8_exact_dedup": dedup.ORACLE,
    }
