"""Class histograms, class and sample weights, dataset statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.project import ClassMapping, map_class

BETA = 0.9999  # fixed value: effective-number base


def label_counts(points: DataFrame, label="classification") -> DataFrame:
    return points.groupBy("file_id", label).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(counts: DataFrame, mapping=None, label="classification") -> DataFrame:
    """Sum over files in training labels; labels outside the mapping are dropped."""
    m = mapping if isinstance(mapping, ClassMapping) else ClassMapping(mapping)
    mapped = counts.withColumn("class", map_class(label, m))
    if m.forward is not None:
        mapped = mapped.filter(F.col("class") != m.ignore_label)
    return mapped.groupBy("class").agg(F.sum("n").alias("n"))


def class_weights(distribution: DataFrame, method="sqrt_inverse", smooth=1.0, normalize=True) -> DataFrame:
    """Weight per class 0..largest; an empty class counts as one point; the smallest weight is 1.

    Works on the class table (one row per class), whatever the size of the data.
    """
    span = distribution.agg(F.max("class").alias("m"))
    full = span.select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("class"))
    c = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).cast("double")
    s = F.lit(float(smooth))
    formula = {
        "inverse": F.lit(1.0) / (c + s),
        "sqrt_inverse": F.lit(1.0) / F.sqrt(c + s),
        "log_inverse": F.lit(1.0) / F.log(c + s + F.lit(1.0)),
        "effective_num": F.lit(1.0 - BETA) / (F.lit(1.0) - F.pow(F.lit(BETA), c) + F.lit(1e-8)),
    }
    if method not in formula:
        raise ValueError(f"unknown method {method}; known: {sorted(formula)}")
    w = full.join(distribution, "class", "left").select("class", formula[method].alias("weight"))
    if not normalize:
        return w
    low = w.agg(F.min("weight").alias("_low")).withColumn("_one", F.lit(1))
    return w.withColumn("_one", F.lit(1)).join(low, "_one").select("class", (F.col("weight") / F.col("_low")).alias("weight"))


def sample_weights(tiles: DataFrame, weights: DataFrame, keys: list[str], mapping=None, labels="unique_labels", loops: int = 1) -> DataFrame:
    """Sum of the class weights of the tile's distinct raw labels, at least 1e-6; a tile without
    labels weighs 1. `weights` has one row per class."""
    m = mapping if isinstance(mapping, ClassMapping) else ClassMapping(mapping)
    long = tiles.select(*keys, F.explode(labels).alias("raw")).withColumn("class", map_class("raw", m))
    summed = long.join(weights, "class", "left").groupBy(*keys).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("_w"))
    out = tiles.select(*keys).join(summed, keys, "left")
    out = out.withColumn("weight", F.when(F.col("_w").isNull(), 1.0).otherwise(F.greatest("_w", F.lit(1e-6)))).drop("_w")
    return out if loops == 1 else out.withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))


def dataset_stats(tiles: DataFrame) -> DataFrame:
    """Totals and spread over the tile table. The exact median keeps counts per distinct size."""
    return tiles.agg(
        F.count(F.lit(1)).alias("num_tiles"),
        F.sum("num_points").alias("total_points"),
        F.avg("num_points").alias("mean_points"),
        F.median("num_points").alias("median_points"),
        F.min("num_points").alias("min_points"),
        F.max("num_points").alias("max_points"),
        F.stddev_pop("num_points").alias("std_points"),
        F.avg("num_voxels").alias("mean_voxels"),
        F.min("num_voxels").alias("min_voxels"),
        F.max("num_voxels").alias("max_voxels"),
    )


def class_share(counts: DataFrame, label="classification") -> DataFrame:
    """Histogram with percent, over the small per-class table."""
    per = counts.groupBy(label).agg(F.sum("n").alias("n")).withColumn("_one", F.lit(1))
    total = per.groupBy("_one").agg(F.sum("n").alias("_t"))
    return per.join(total, "_one").select(label, "n", (F.col("n") / F.col("_t") * 100.0).alias("percent"))


def distinct_points(df: DataFrame, key: str | list[str], out="distinct") -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.agg(F.count_distinct(*keys).alias(out))
