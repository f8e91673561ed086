"""Merging of overlapping predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.vectors import argmax
from cloudloom.operators.project import unmap_class

POINT = ["file_id", "point_id"]


def logit_sums(predictions: DataFrame, num_classes: int, keys=POINT) -> DataFrame:
    """Sum per class and number of votes: the state that may be merged again."""
    sums = [F.sum(F.get(F.col("logits"), F.lit(c)).cast("double")).alias(f"s{c}") for c in range(num_classes)]
    return predictions.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("votes"))


def mean_of_sums(sums: DataFrame, num_classes: int, keys=POINT) -> DataFrame:
    mean = F.array(*[F.col(f"s{c}") / F.greatest(F.col("votes"), F.lit(1)) for c in range(num_classes)])
    return sums.select(*keys, mean.alias("mean_logits"), "votes")


def vote_logits(predictions: DataFrame, num_classes: int, keys=POINT) -> DataFrame:
    """Mean logits per point over all draws: one hash aggregate with `num_classes` sums, combined
    before the shuffle; no row per (point, class)."""
    return mean_of_sums(logit_sums(predictions, num_classes, keys), num_classes, keys)


def vote_label(votes: DataFrame) -> DataFrame:
    return votes.withColumn("label", argmax("mean_logits"))


def restore_votes(points: DataFrame, labels: DataFrame, mapping=None, unknown="keep") -> DataFrame:
    """Every point with its voted class. A point without a vote counts as training label 0, before
    the reverse mapping, and is told apart by `covered`."""
    out = points.join(labels.select(*POINT, F.col("label").alias("_label")), POINT, "left")
    train = F.coalesce("_label", F.lit(0))
    return out.withColumns(
        {"covered": F.col("_label").isNotNull(), "classification": unmap_class(train, mapping, unknown)}
    ).drop("_label")


def vote_coverage(points: DataFrame, votes: DataFrame) -> DataFrame:
    """Points, points with a vote and their share, per file. Each side is aggregated on its own."""
    total = points.groupBy("file_id").agg(F.count(F.lit(1)).alias("num_points"))
    got = votes.groupBy("file_id").agg(F.count_if(F.col("votes") > 0).alias("covered"))
    out = total.join(got, "file_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.withColumn("coverage", F.col("covered") / F.col("num_points") * F.lit(100.0))


def missing_files(expected: DataFrame, seen: DataFrame, key="file_id") -> DataFrame:
    """Files expected but not seen, and seen but not expected."""
    e, s = expected.select(key).distinct(), seen.select(key).distinct()
    lost = e.join(s, key, "left_anti").withColumn("status", F.lit("missing"))
    extra = s.join(e, key, "left_anti").withColumn("status", F.lit("unexpected"))
    return lost.unionByName(extra)


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Batches, rows and files seen in a run. Distinct counts run over the pre-grouped pairs."""
    pairs = predictions.groupBy("file_id", "batch_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.count_distinct("batch_id").alias("batches"),
        F.sum("n").alias("rows"),
        F.count_distinct("file_id").alias("files"),
    )
