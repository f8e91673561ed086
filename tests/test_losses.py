import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import losses, metrics
from cloudloom.operators.neighbors import knn_self


def lovasz(err, fg):
    order = np.argsort(-err, kind="stable")
    e, g = err[order], fg[order]
    inter, union = g.sum() - g.cumsum(), g.sum() + (1 - g).cumsum()
    jac = 1 - inter / union
    return float((e * np.diff(jac, prepend=0)).sum())


def test_lovasz_of_a_large_group_and_copies(spark):
    rng = np.random.default_rng(2)
    err = np.where(rng.random(500) < 0.34, 0.5, rng.random(500))
    fg = rng.integers(0, 2, size=500)
    df = spark.createDataFrame(pd.DataFrame({"err": err, "fg": fg, "k": 0}))
    for limit in (40, 10_000):
        g = losses.lovasz_gradient(df, ["k"], group_rows=limit)
        assert g.count() == len(np.unique(err))
        got = g.agg(F.sum(F.col("err") * F.col("grad"))).first()[0]
        assert abs(got - lovasz(err, fg)) < 1e-9


def predictions(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame(
        [(i, int(t), [float(v) for v in row]) for i, (t, row) in enumerate(zip(rng.integers(-1, 4, 200), rng.normal(size=(200, 4))))],
        "id int, target int, logits array<double>",
    )


def test_losses_against_numpy(spark):
    df = predictions(spark)
    rows = df.filter("target >= 0").toPandas()
    x, t = np.array(rows["logits"].tolist()), rows["target"].to_numpy()
    p = np.exp(x) / np.exp(x).sum(1, keepdims=True)
    pt = p[np.arange(len(t)), t]
    one = lambda d: d.first()[0]
    assert abs(one(losses.eval_cross_entropy(df, 4)) + np.log(pt).mean()) < 1e-9
    assert abs(one(losses.eval_focal(df, 4)) - ((1 - pt) ** 2 * -np.log(pt)).mean()) < 1e-9
    hot = np.eye(4)[t]
    for square in (False, True):
        den = (p**2).sum(0) + hot.sum(0) if square else p.sum(0) + hot.sum(0)
        want = (1 - (2 * (p * hot).sum(0) + 1) / (den + 1)).mean()
        assert abs(one(losses.eval_dice(df, 4, square=square)) - want) < 1e-9
    seen = np.mean([lovasz(np.abs(hot[:, c] - p[:, c]), hot[:, c]) for c in np.unique(t)])
    assert abs(one(losses.eval_lovasz_softmax(df, 4)) - seen) < 1e-9


def test_empty_scores(spark):
    none = spark.createDataFrame([], "target int, pred int")
    cm = metrics.confusion_matrix(none)
    per = metrics.per_class_metrics(metrics.tp_fp_fn(cm, 3), 3)
    assert per.count() == 3
    assert metrics.overall_accuracy(cm).first()[0] == 0.0
    assert metrics.mean_iou(per).first()[0] == 0.0
    assert metrics.segmentation_report(per).first()["overall_accuracy"] is None


def test_precision_means_differ_by_class_filter(spark):
    # class 2 is predicted but never a target: only the macro precision counts it
    cm = spark.createDataFrame([(0, 0, 4), (1, 1, 2), (0, 2, 2)], "target int, pred int, n bigint")
    per = metrics.per_class_metrics(metrics.tp_fp_fn(cm, 3), 3)
    assert abs(metrics.macro_precision(per).first()[0] - 2 / 3) < 1e-6
    assert abs(metrics.segmentation_report(per).first()["mean_precision"] - 1.0) < 1e-6


def test_statistics_without_keys(spark):
    from cloudloom.operators.pooling import segment_max_pool

    df = spark.createDataFrame([(1, 2.0), (2, 5.0)], "id int, v double")
    assert [r.v_max for r in segment_max_pool(df, [], ["v"]).collect()] == [5.0, 5.0]
    flat = spark.createDataFrame([(1.0, 1), (-2.0, 0), (0.5, 0)], "logit double, label int")
    x, t = np.array([1.0, -2.0, 0.5]), np.array([1, 0, 0])
    err = 1 - x * (2 * t - 1)
    order = np.argsort(-err)
    g = t[order]
    jac = 1 - (g.sum() - g.cumsum()) / (g.sum() + (1 - g).cumsum())
    want = float((np.maximum(err[order], 0) * np.diff(jac, prepend=0)).sum())
    assert abs(losses.eval_lovasz_hinge(flat).first()[0] - want) < 1e-9


def test_label_consistency_without_a_join_of_the_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 2, i, *map(float, rng.integers(0, 9, 3)), [float(v) for v in rng.integers(0, 5, 3)], int(rng.integers(-1, 3))) for i in range(80)]
    df = spark.createDataFrame(rows, "b long, point_id long, x double, y double, z double, logits array<double>, label int")
    want = losses.eval_label_consistency(knn_self(df, 4, ["b"]), df, ["b"], 3, loss_weight=2.0)
    got = losses.knn_label_consistency(df, 4, ["b"], 3, loss_weight=2.0)
    above = lambda d: d._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert "Join" in above(want) and "Join" not in above(got)
    assert got.first()[0] == pytest.approx(want.first()[0], abs=1e-12) and got.first()[0] > 0
