"""Metrics, losses, weights, batches and run history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cloudloom.catalog.base import (
    C, CLASSES, CM, MAPPING, ORG, PACK, PACK_LIMIT, PER, PRD, PTS, RUN, SM, SMP, T, TEL, TILES, cte, out, query, samples, sql,
    tile_table, tiled, tp_cte,
)
from cloudloom.operators import batching, losses, metrics, tiling, weights
from cloudloom.operators.project import argmax_label
from cloudloom.plans.jobs import evaluate
from cloudloom.schemas import TILE
from cloudloom.session import cut_lineage

REVERSE = {i: i + 1 for i in range(CLASSES)}
TC = T.replace(",", "")


def cm(t):
    return metrics.confusion_matrix(argmax_label(t.predictions()))


def per(t):
    return metrics.per_class_metrics(metrics.tp_fp_fn(cm(t), CLASSES), CLASSES, reverse=REVERSE)


# --- metrics ----------------------------------------------------------------------------------
query("confusion_matrix", sql(CM, "SELECT * FROM cm", "target pred n"))(cm)
query("metric_state", sql(SM, "SELECT target, pred, count(*) AS n FROM sm WHERE target <> -1 GROUP BY ALL", "target pred n"))(
    lambda t: metrics.merge_confusion(
        *[metrics.confusion_matrix(argmax_label(t.predictions().filter(F.col("loop_idx") == i))) for i in range(3)]
    )
)
query("confusion_errors", sql(CM, "SELECT * FROM cm WHERE target <> pred", "target pred n"))(lambda t: metrics.confusion_errors(cm(t)))
query("dense_confusion", sql(cte(CM, f"g AS (SELECT CAST(a AS INTEGER) AS target, CAST(b AS INTEGER) AS pred FROM (SELECT unnest(range(0, {CLASSES})) AS a) CROSS JOIN (SELECT unnest(range(0, {CLASSES})) AS b))"), "SELECT target, pred, coalesce(n, 0) AS n FROM g LEFT JOIN cm USING (target, pred)", "target pred n"))(
    lambda t: metrics.dense_confusion(cm(t), CLASSES)
)
query("tp_fp_fn", sql(PER, "SELECT * FROM tpf", "class tp fp fn"))(lambda t: metrics.tp_fp_fn(cm(t), CLASSES))
query("per_class_metrics", sql(PER, "SELECT * FROM per", "class tp fp fn name", "iou precision recall f1"))(lambda t: out(per(t)))
query("overall_accuracy", sql(CM, "SELECT coalesce(sum(n) FILTER (WHERE target = pred), 0) / sum(n) AS overall_accuracy FROM cm", "", "overall_accuracy"))(
    lambda t: out(metrics.overall_accuracy(cm(t)))
)
for _name, _value, _test in (
    ("mean_iou", "iou", "tp + fn > 0"), ("macro_precision", "precision", "tp + fp > 0"), ("macro_recall", "recall", "tp + fn > 0"), ("macro_f1", "f1", "tp + fn > 0"),
):
    query(_name, sql(PER, f"SELECT coalesce(avg({_value}) FILTER (WHERE {_test}), 0) AS {_name} FROM per", "", _name))(
        lambda t, f=getattr(metrics, _name): out(f(per(t)))
    )
query(
    "segmentation_report",
    sql(PER, "SELECT sum(tp) / sum(tp + fn) AS overall_accuracy, avg(iou) FILTER (WHERE tp + fn > 0) AS mean_iou, avg(precision) FILTER (WHERE tp + fn > 0) AS mean_precision, "
        "avg(recall) FILTER (WHERE tp + fn > 0) AS mean_recall, avg(f1) FILTER (WHERE tp + fn > 0) AS mean_f1 FROM per", "", "overall_accuracy mean_iou mean_precision mean_recall mean_f1"),
)(lambda t: out(metrics.segmentation_report(per(t))))
query(
    "evaluate",
    sql(PER, "SELECT sum(tp) / sum(tp + fn) AS overall_accuracy, avg(iou) FILTER (WHERE tp + fn > 0) AS mean_iou, avg(precision) FILTER (WHERE tp + fn > 0) AS mean_precision, "
        "avg(recall) FILTER (WHERE tp + fn > 0) AS mean_recall, avg(f1) FILTER (WHERE tp + fn > 0) AS mean_f1 FROM per", "", "overall_accuracy mean_iou mean_precision mean_recall mean_f1"),
)(lambda t: out(evaluate(t.predictions(), CLASSES, reverse=REVERSE)[2]))
query(
    "report_table",
    sql(PER, "SELECT name, iou, precision, recall, f1 FROM per UNION ALL SELECT 'Mean', avg(iou) FILTER (WHERE tp + fn > 0), avg(precision), avg(recall), avg(f1) FROM per", "name", "iou precision recall f1"),
)(lambda t: out(metrics.report_table(per(t))))
W3 = "(PARTITION BY experiment ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
W4 = "(PARTITION BY experiment ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
query(
    "best_so_far",
    sql(cte(RUN, f"b AS (SELECT *, max(mean_iou) OVER {W3} AS best, max(mean_iou) OVER {W4} AS before FROM runs)",
            "n AS (SELECT *, before IS NULL OR mean_iou > before AS is_new_best FROM b)"),
        f"SELECT *, max(CASE WHEN is_new_best THEN epoch END) OVER {W3} AS best_epoch FROM n", "experiment epoch best_epoch is_new_best", "best"),
)(lambda t: out(metrics.best_so_far(t.runs(), ["experiment"]).select("experiment", "epoch", "best_epoch", "is_new_best", "best")))
query("latest_or_best_run", sql(RUN, "SELECT experiment, arg_max(path, (is_best, mtime, path)) AS path, bool_or(is_best) AS is_best FROM runs GROUP BY experiment", "experiment path is_best"))(
    lambda t: metrics.latest_or_best_run(t.runs(), ["experiment"])
)
query("topk_runs", sql(RUN, "SELECT * FROM runs ORDER BY mean_iou DESC, epoch LIMIT 3", "experiment epoch path", "mean_iou"))(
    lambda t: out(metrics.topk_runs(t.runs(), 3), "experiment", "epoch", "path", "mean_iou")
)

# --- losses -----------------------------------------------------------------------------------
WEIGHT = [1.0, 0.5, 2.0, 1.5, 1.0, 0.25, 3.0, 1.0]


def pick(prefix):
    return "CASE target " + " ".join(f"WHEN {c} THEN {prefix}{c}" for c in C) + " END"


WT = "CASE target " + " ".join(f"WHEN {c} THEN {w!r}e0" for c, w in enumerate(WEIGHT)) + " END"
SPREAD = " + ".join(f"{w!r}e0 * -q{c}" for c, w in enumerate(WEIGHT))
OK = cte(SM, f"ok AS (SELECT *, {WT} AS wt, {pick('q')} AS qt, {pick('p')} AS pt, ({SPREAD}) / {CLASSES} AS sp FROM sm WHERE target <> -1)")
CE = "SELECT (0.9e0 * sum(wt * -qt) + 0.1e0 * sum(sp)) / sum(wt) AS cross_entropy FROM ok"
query("eval_cross_entropy", sql(OK, CE, "", "cross_entropy"))(
    lambda t: out(losses.eval_cross_entropy(t.predictions(), CLASSES, WEIGHT, label_smoothing=0.1))
)
query("eval_focal", sql(OK, "SELECT avg(wt * pow(1 - pt, 2) * -qt) AS focal FROM ok", "", "focal"))(
    lambda t: out(losses.eval_focal(t.predictions(), CLASSES, WEIGHT))
)
DICE = " UNION ALL ".join(
    f"SELECT {c} AS class, {WEIGHT[c]!r}e0 * (1 - (2 * sum(CASE WHEN target = {c} THEN p{c} ELSE 0 END) + 1) / (sum(p{c}) + count(*) FILTER (WHERE target = {c}) + 1)) AS dice FROM ok" for c in C
)
query("eval_dice", sql(cte(OK, f"dc AS ({DICE})"), "SELECT avg(dice) AS dice FROM dc", "", "dice"))(
    lambda t: out(losses.eval_dice(t.predictions(), CLASSES, weight=WEIGHT))
)
query("eval_dice_ce", sql(cte(OK, f"dc AS ({DICE})", f"ce AS ({CE})"), "SELECT 0.3e0 * (SELECT avg(dice) FROM dc) + 0.7e0 * cross_entropy AS dice_ce FROM ce", "", "dice_ce"))(
    lambda t: out(losses.eval_dice_ce(t.predictions(), CLASSES, 0.3, 0.7, class_weight=WEIGHT, label_smoothing=0.1))
)
ERR = " UNION ALL ".join(f"SELECT file_id, point_id, loop_idx, {c} AS class, CAST(target = {c} AS INTEGER) AS fg, abs(CAST(target = {c} AS INTEGER) - p{c}) AS err FROM ok" for c in C)


def lovasz(keys):
    """Per row: rank all errors of a group, running Jaccard loss, first difference."""
    order = "ORDER BY err DESC, file_id, point_id, loop_idx"
    return cte(
        f"lg AS (SELECT *, sum(fg) OVER (PARTITION BY {keys}) AS gts, sum(fg) OVER w AS cf, sum(1 - fg) OVER w AS cb, row_number() OVER w AS rn FROM er WINDOW w AS (PARTITION BY {keys} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
        "lj AS (SELECT *, 1 - (gts - cf) / (gts + cb) AS jac FROM lg)",
        f"lz AS (SELECT *, jac - coalesce(lag(jac) OVER (PARTITION BY {keys} ORDER BY rn), 0) AS grad FROM lj)",
    )


query(
    "eval_lovasz_softmax",
    sql(cte(OK, f"er AS ({ERR})", lovasz("class"), "pl AS (SELECT class, sum(err * grad) AS loss FROM lz WHERE gts > 0 GROUP BY class)"), "SELECT avg(loss) AS lovasz_softmax FROM pl", "", "lovasz_softmax"),
)(lambda t: out(losses.eval_lovasz_softmax(t.predictions(), CLASSES)))
HINGE = "er AS (SELECT file_id, point_id, loop_idx, CAST(target = 0 AS INTEGER) AS fg, 1 - (logits[1] - 6) * (2 * CAST(target = 0 AS INTEGER) - 1) AS err FROM prd WHERE target <> -1)"


def binary(t):
    p = t.predictions().filter("target <> -1")
    return p.select("file_id", "point_id", "loop_idx", (F.get("logits", F.lit(0)) - 6).alias("logit"), (F.col("target") == 0).cast("int").alias("label"))


query("eval_lovasz_hinge", sql(cte(PRD, HINGE, lovasz("file_id"), "pl AS (SELECT file_id, sum(greatest(err, 0) * grad) AS loss FROM lz GROUP BY file_id)"), "SELECT avg(loss) AS lovasz_hinge FROM pl", "", "lovasz_hinge"))(
    lambda t: out(losses.eval_lovasz_hinge(binary(t), ["file_id"]))
)
# the steps of equal errors are added up, as the operator does
query("lovasz_gradient", sql(cte(PRD, HINGE, lovasz("file_id")), "SELECT file_id, err, CAST(sum(fg) AS BIGINT) AS n_fg, CAST(sum(1 - fg) AS BIGINT) AS n_bg, sum(grad) AS grad FROM lz GROUP BY file_id, err", "file_id n_fg n_bg", "err grad"))(
    lambda t: out(losses.lovasz_gradient(binary(t).select("file_id", (1 - F.col("logit") * (2 * F.col("label") - 1)).alias("err"), F.col("label").alias("fg")), ["file_id"]))
)
query("total_loss", sql(OK, f"SELECT 0.6e0 * avg(wt * pow(1 - pt, 2) * -qt) + 0.4e0 * ({CE}) AS total_loss FROM ok", "", "total_loss"))(
    lambda t: out(
        losses.total_loss(
            losses.eval_focal(t.predictions(), CLASSES, WEIGHT).select(F.lit(0.6).alias("w"), F.col("focal").alias("v")).unionByName(
                losses.eval_cross_entropy(t.predictions(), CLASSES, WEIGHT, label_smoothing=0.1).select(F.lit(0.4).alias("w"), F.col("cross_entropy").alias("v"))
            )
        )
    )
)
query("epoch_loss", sql(TEL, "SELECT run, stage, sum(duration * (event_id % 7 + 1)) / sum(event_id % 7 + 1) AS epoch_loss FROM tel GROUP BY run, stage", "run stage", "epoch_loss"))(
    lambda t: out(losses.epoch_loss(t.telemetry().withColumns({"loss": F.col("duration"), "batch_size": F.col("event_id") % 7 + 1}), ["run", "stage"]))
)

# --- weights ----------------------------------------------------------------------------------
LC = cte(PTS, "lc AS (SELECT file_id, classification, count(*) AS n FROM pts GROUP BY ALL)")
CD = cte(LC, "cd AS (SELECT classification - 1 AS class, CAST(sum(n) AS BIGINT) AS n FROM lc WHERE classification BETWEEN 1 AND 8 GROUP BY 1)")
query("label_counts", sql(LC, "SELECT * FROM lc", "file_id classification n"))(lambda t: weights.label_counts(t.points()))


def dist(t):
    return weights.class_distribution(weights.label_counts(t.points()), MAPPING)


query("class_distribution", sql(CD, "SELECT * FROM cd", "class n"))(dist)
FORM = {"inverse": "1 / (c + 1)", "sqrt_inverse": "1 / sqrt(c + 1)", "log_inverse": "1 / ln(c + 2)", "effective_num": "(1 - 0.9999e0) / (1 - pow(0.9999e0, c) + 1e-8)"}
CW = cte(CD, "cc AS (SELECT class, CAST(n AS DOUBLE) AS c FROM cd)", "cw AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, class, ({e}) / min({e}) OVER () AS weight FROM cc" for m, e in FORM.items()) + ")")


@query("class_weights", sql(CW, "SELECT * FROM cw", "method class", "weight"))
def _(t):
    got, counts = None, cut_lineage(dist(t))
    for m in FORM:
        w = weights.class_weights(counts, m).select(F.lit(m).alias("method"), "class", "weight")
        got = w if got is None else got.unionByName(w)
    return out(got)


query(
    "sample_weights",
    sql(cte(CW, ORG, tp_cte(), f"tl AS (SELECT DISTINCT {T}, classification FROM tp)"),
        f"SELECT {T}, greatest(sum(coalesce(weight, 0)), 1e-6) AS weight FROM tl LEFT JOIN cw ON method = 'sqrt_inverse' AND class = classification - 1 GROUP BY {T}", TC, "weight"),
)(lambda t: out(weights.sample_weights(tiling.tile_labels(tiled(t)), weights.class_weights(dist(t)), TILE, MAPPING)))
query(
    "dataset_stats",
    sql(TILES, "SELECT count(*) AS num_tiles, CAST(sum(num_points) AS BIGINT) AS total_points, avg(num_points) AS mean_points, median(num_points) AS median_points, min(num_points) AS min_points, max(num_points) AS max_points, "
        "stddev_pop(num_points) AS std_points, avg(num_voxels) AS mean_voxels, min(num_voxels) AS min_voxels, max(num_voxels) AS max_voxels FROM tiles", "num_tiles total_points min_points max_points min_voxels max_voxels", "mean_points median_points std_points mean_voxels"),
)(lambda t: out(weights.dataset_stats(tile_table(t))))
query("distinct_points", sql(PRD, "SELECT count(*) AS \"distinct\" FROM (SELECT DISTINCT file_id, point_id FROM prd)", '"distinct"'))(
    lambda t: weights.distinct_points(t.predictions(), ["file_id", "point_id"])
)

# --- batches ----------------------------------------------------------------------------------


def packed(t):
    return batching.pack_batches(samples(t), "sample_id", "num_points", PACK_LIMIT)


query("pack_batches", sql(PACK, "SELECT * FROM pk", "sample_id num_points batch_id", recursive=True))(
    lambda t: packed(t).select("sample_id", "num_points", "batch_id")
)
OFF = cte(PACK, 'ofs AS (SELECT *, CAST(sum(num_points) OVER (PARTITION BY batch_id ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS "offset" FROM pk)')
query("batch_offsets", sql(OFF, "SELECT * FROM ofs", 'sample_id batch_id "offset"', recursive=True))(
    lambda t: batching.batch_offsets(packed(t), "sample_id", "num_points").select("sample_id", "batch_id", "offset")
)


@query("offset_convert", sql(cte(OFF, 'pr AS (SELECT sample_id, batch_id, num_points AS n, unnest(range("offset" - num_points, "offset")) AS row FROM ofs)'), 'SELECT * FROM pr JOIN (SELECT sample_id, "offset" FROM ofs) USING (sample_id)', 'sample_id batch_id n "row" "offset"', recursive=True))
def _(t):
    """All four directions: offset -> counts -> offset and offset -> rows -> offset."""
    o = batching.batch_offsets(packed(t), "sample_id", "num_points")
    o = o.withColumn("element", F.row_number().over(Window.partitionBy("batch_id").orderBy("sample_id")).cast("long"))
    key = ["batch_id"]
    rows = batching.offset_to_rows(o.select("batch_id", "element", "offset"), key)
    back = batching.rows_to_offset(rows, key)
    counts = batching.offset_to_counts(back.select("batch_id", "element", "offset"), key)
    again = batching.counts_to_offset(counts.select("batch_id", "element", "n"), key)
    return rows.join(again, ["batch_id", "element"]).join(o.select("batch_id", "element", "sample_id"), ["batch_id", "element"]).select("sample_id", "batch_id", "n", "row", "offset")


query("batch_count_exact", sql(PACK, "SELECT count(DISTINCT batch_id) AS batches FROM pk", "batches", recursive=True))(lambda t: batching.batch_count_exact(packed(t)))
EST = f"greatest(CAST(floor(count(*) / ({PACK_LIMIT}e0 / avg(num_points)) * 0.95e0) AS BIGINT), 1)"
query("batch_count_estimate", sql(SMP, f"SELECT {EST} AS batches FROM smp", "batches"))(
    lambda t: batching.batch_count_estimate(samples(t), "num_points", PACK_LIMIT)
)
query("fixed_batches", sql(cte(SMP, "fb AS (SELECT *, (row_number() OVER (ORDER BY sample_id) - 1) // 16 AS batch_id FROM smp)"), "SELECT * FROM fb", "sample_id batch_id"))(
    lambda t: batching.fixed_batches(samples(t), "sample_id", 16).select("sample_id", "batch_id")
)
query("collate", sql(PACK, "SELECT o_orderkey AS point_id, sample_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY sample_id, o_orderkey) - 1 AS pos_in_batch FROM orders JOIN pk ON sample_id = o_custkey", "point_id sample_id batch_id pos_in_batch", recursive=True))(
    lambda t: batching.collate(t.raw("orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("point_id")), packed(t).withColumn("ord", F.col("sample_id")), ["sample_id"], "ord").select("point_id", "sample_id", "batch_id", "pos_in_batch")
)
query(
    "batch_summary",
    sql(cte(PACK, "pb AS (SELECT batch_id, count(*) AS s, CAST(sum(num_points) AS BIGINT) AS p FROM pk GROUP BY batch_id)"),
        "SELECT count(*) AS batches, min(s) AS min_samples, max(s) AS max_samples, avg(s) AS mean_samples, min(p) AS min_points, max(p) AS max_points, avg(p) AS mean_points FROM pb",
        "batches min_samples max_samples min_points max_points", "mean_samples mean_points", recursive=True),
)(lambda t: out(batching.batch_summary(packed(t), "num_points")))
