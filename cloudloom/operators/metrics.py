"""Segmentation metrics over a table of (target, pred) rows.

The state is the sparse confusion table with BIGINT counts. It is at most classes x classes rows,
so everything after the first aggregate is independent of the data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators.ordering import GROUP_ROWS, ordered_prefix
from cloudloom.operators.project import class_names, drop_ignored

EPS = 1e-10  # fixed value


def confusion_matrix(predictions: DataFrame, ignore_index=-1, target="target", pred="pred") -> DataFrame:
    df = drop_ignored(predictions, target, ignore_index)
    return df.groupBy(F.col(target).alias("target"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def merge_confusion(*parts: DataFrame) -> DataFrame:
    """Sum of partial states."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("target", "pred").agg(F.sum("n").alias("n"))


def dense_confusion(cm: DataFrame, num_classes: int) -> DataFrame:
    """One row per (target, pred), zeros included: num_classes^2 rows made by explode."""
    axis = F.sequence(F.lit(0), F.lit(num_classes - 1))
    full = cm.sparkSession.range(1).select(F.explode(axis).alias("target"))
    full = full.select("target", F.explode(axis).alias("pred"))
    return full.join(cm, ["target", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_errors(cm: DataFrame) -> DataFrame:
    return cm.filter(F.col("target") != F.col("pred"))


def tp_fp_fn(cm: DataFrame, num_classes: int) -> DataFrame:
    """Counts per class; every class is present."""
    hit = F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0)
    rows = cm.select(F.col("target").alias("class"), hit.alias("tp"), F.lit(0).alias("fp"), (F.col("n") - hit).alias("fn"))
    cols = cm.select(F.col("pred").alias("class"), F.lit(0).alias("tp"), (F.col("n") - hit).alias("fp"), F.lit(0).alias("fn"))
    base = cm.sparkSession.range(num_classes).select(
        F.col("id").cast("int").alias("class"), *[F.lit(0).alias(c) for c in ("tp", "fp", "fn")]
    )
    cast = lambda d: d.select(F.col("class").cast("int").alias("class"), *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    both = cast(rows).unionByName(cast(cols)).unionByName(cast(base))
    return both.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def per_class_metrics(counts: DataFrame, num_classes: int, names=None, reverse=None) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    eps = F.lit(EPS)
    out = counts.withColumns(
        {
            "iou": tp / (tp + fp + fn + eps),
            "precision": tp / (tp + fp + eps),
            "recall": tp / (tp + fn + eps),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", F.lit(2.0) * p * r / (p + r + eps))
    return out.withColumn("name", class_names("class", num_classes, names, reverse))


def _mean_where(value, test):
    return F.coalesce(F.avg(F.when(test, F.col(value))), F.lit(0.0))


def _in_target():
    return F.col("tp") + F.col("fn") > 0


def _in_pred():
    return F.col("tp") + F.col("fp") > 0


def overall_accuracy(cm: DataFrame) -> DataFrame:
    """Share of correct rows; 0 on an empty table."""
    hit = F.sum(F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0))
    return cm.agg(F.coalesce(F.try_divide(hit, F.sum("n")), F.lit(0.0)).alias("overall_accuracy"))


def mean_iou(metrics: DataFrame) -> DataFrame:
    return metrics.agg(_mean_where("iou", _in_target()).alias("mean_iou"))


def macro_precision(metrics: DataFrame) -> DataFrame:
    """Over the classes that were predicted at least once."""
    return metrics.agg(_mean_where("precision", _in_pred()).alias("macro_precision"))


def macro_recall(metrics: DataFrame) -> DataFrame:
    return metrics.agg(_mean_where("recall", _in_target()).alias("macro_recall"))


def macro_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(_mean_where("f1", _in_target()).alias("macro_f1"))


def segmentation_report(metrics: DataFrame) -> DataFrame:
    """All scores in one pass; here every mean runs over the classes that occur in the targets,
    and the accuracy of an empty table is null."""
    total = F.sum(F.col("tp") + F.col("fn"))
    return metrics.agg(
        F.try_divide(F.sum("tp"), total).alias("overall_accuracy"),
        *[
            _mean_where(c, _in_target()).alias(n)
            for n, c in (("mean_iou", "iou"), ("mean_precision", "precision"), ("mean_recall", "recall"), ("mean_f1", "f1"))
        ],
    )


def report_table(metrics: DataFrame) -> DataFrame:
    """Per-class rows and a footer: means of precision, recall and F1 over all classes, while the
    IoU of the footer is the mean over classes that occur."""
    body = metrics.select("name", "iou", "precision", "recall", "f1")
    foot = metrics.agg(
        _mean_where("iou", _in_target()).alias("iou"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
    )
    return body.unionByName(foot.select(F.lit("Mean").alias("name"), "iou", "precision", "recall", "f1"))


def best_so_far(runs: DataFrame, keys: list[str], epoch="epoch", metric="mean_iou", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Running best, the epoch it was first reached, and whether this epoch set it."""
    here = F.struct(F.col(metric).alias("m"), (-F.col(epoch)).alias("e"))
    df = ordered_prefix(runs, keys, [epoch], maxes={"_p": here}, group_rows=group_rows)
    best = F.greatest(F.col("_p"), here)
    new = F.col("_p").isNull() | (F.col(metric) > F.col("_p.m"))
    return df.withColumns({"best": best["m"], "best_epoch": -best["e"], "is_new_best": new}).drop("_p")


def latest_or_best_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The path of the newest run marked best, else of the newest run."""
    pick = F.max_by("path", F.struct("is_best", "mtime", "path"))
    return runs.groupBy(*keys).agg(pick.alias("path"), F.max("is_best").alias("is_best"))


def topk_runs(runs: DataFrame, k=3, keys: list[str] = (), metric="mean_iou", epoch="epoch") -> DataFrame:
    """k best runs, ties to the earlier epoch. Without keys it is a distributed top-k."""
    order = [F.col(metric).desc(), F.col(epoch)]
    if not keys:
        return runs.orderBy(*order).limit(k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return runs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
