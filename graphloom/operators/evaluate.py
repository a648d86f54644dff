"""Label handling and metrics, as joins, windows and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.numeric import argmax
from graphloom.operators.graph import numbered, sums_before


def permutation_split(labels: DataFrame, ratio: float, seed: int | None = 0, order: str = "line_no") -> DataFrame:
    """``labels`` with ``part`` train or test: rows in file order are permuted by numpy's legacy generator.

    The permutation is made on the driver, sixteen bytes a row; label files are small by nature.
    """
    spark, rows = labels.sparkSession, numbered(labels, F.col(order))
    n = labels.count()
    rank = np.argsort(np.random.RandomState(seed).permutation(n))
    place = spark.createDataFrame(pa.table({"idx": np.arange(n), "place": rank.astype(np.int64)}))
    return rows.join(place, "idx").withColumn("part", F.when(F.col("place") < int(ratio * n), "train").otherwise("test"))


def label_index(labels: DataFrame) -> DataFrame:
    """(label, label_id): labels numbered in their order as strings, from an (id, label) table."""
    return labels.select("label").distinct().select("label", (F.row_number().over(Window.orderBy(F.col("label").cast("string"))) - 1).alias("label_id"))


def top_ranked(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, label): for each node as many best-scored labels as it truly has; nodes without labels get none."""
    counts = truth.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "label"))
    return scores.join(counts, "id").withColumn("_r", best).where("_r <= k").select("id", "label")


def f1_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(micro, macro, samples, weighted): F1 averages of two (id, label) tables; 0 where undefined."""
    both = truth.select("id", "label", F.lit(1).alias("t")).join(predicted.select("id", "label", F.lit(1).alias("p")), ["id", "label"], "full")
    t, p = F.coalesce("t", F.lit(0)), F.coalesce("p", F.lit(0))
    marks = both.select("id", "label", (t * p).alias("tp"), ((1 - t) * p).alias("fp"), (t * (1 - p)).alias("fn"))

    def f1(rows: DataFrame) -> DataFrame:
        return rows.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).withColumn("f", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))

    by_label = f1(marks.groupBy("label")).withColumn("n", F.col("tp") + F.col("fn"))
    micro = f1(marks.groupBy()).select(F.col("f").alias("micro"))
    macro = by_label.agg(F.avg("f").alias("macro"), F.coalesce(F.try_divide(F.sum(F.col("f") * F.col("n")), F.sum("n").cast("double")), F.lit(0.0)).alias("weighted"))
    samples = f1(marks.groupBy("id")).agg(F.avg("f").alias("samples"))
    return micro.crossJoin(macro).crossJoin(samples).select("micro", "macro", "samples", "weighted")


def roc_auc(scores: DataFrame) -> DataFrame:
    """(auc) of (score, label): the Mann-Whitney statistic with mid-ranks.

    Ranks are running sums over the distinct scores, after an aggregation by score.
    """
    ties = scores.groupBy("score").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    ranked = sums_before(ties, F.col("score"), ["n"]).withColumn("mid", F.col("before_n") + (F.col("n") + 1) / 2.0)
    total = ranked.agg(F.sum(F.col("mid") * F.col("p")).alias("s"), F.sum("p").cast("double").alias("p"), F.sum(F.col("n") - F.col("p")).cast("double").alias("q"))
    return total.select(((F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q"))).alias("auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """(ap) of (score, label): precision at each distinct score, weighted by the recall it adds."""
    ties = scores.groupBy("score").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    told = sums_before(ties, F.desc("score"), ["p", "n"])
    precision = (F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n")).cast("double")
    return told.withColumn("precision", precision).agg((F.sum(F.col("precision") * F.col("p")) / F.sum("p").cast("double")).alias("ap"))


def masked_accuracy(rows: DataFrame) -> DataFrame:
    """(accuracy) of (probs, y, mask): how often the first largest class is y."""
    return rows.where("mask").agg(F.avg((argmax(F.col("probs")) == F.col("y")).cast("double")).alias("accuracy"))


def masked_cross_entropy(rows: DataFrame) -> DataFrame:
    """(loss) of (logits, y, mask), by a stable log-sum-exp."""
    z = F.col("logits")
    top = F.array_max(z)
    lse = top + F.ln(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return rows.where("mask").agg(F.avg(lse - F.element_at(z, F.col("y") + 1)).alias("loss"))


def early_stop(history: DataFrame, patience: int = 10) -> DataFrame:
    """(epoch): the first epoch after ``patience`` whose loss exceeds the mean of the ``patience`` before it."""
    before = F.avg("val_loss").over(Window.orderBy("epoch").rowsBetween(-patience, -1))
    return history.withColumn("mean", before).where((F.col("epoch") > patience) & (F.col("val_loss") > F.col("mean"))).agg(F.min("epoch").alias("epoch"))


def best_epoch(history: DataFrame, score: str = "macro") -> DataFrame:
    return history.agg(F.max_by("epoch", F.struct(F.col(score), -F.col("epoch"))).alias("epoch"))
