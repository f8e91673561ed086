"""Evaluation of segmentation losses over prediction tables (values only, no gradients)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.vectors import dot, l2_normalise
from cloudloom.operators.neighbors import gather_neighbours, knn_self
from cloudloom.operators.ordering import GROUP_ROWS, ordered_prefix, with_group_stats
from cloudloom.operators.project import drop_ignored


def _weights(weight, num_classes):
    w = [1.0] * num_classes if weight is None else [float(v) for v in weight]
    if len(w) != num_classes:
        raise ValueError(f"{len(w)} weights for {num_classes} classes")
    return [F.lit(v) for v in w]


def _at(cols, index):
    return F.element_at(F.array(*cols), index.cast("int") + 1)


def class_scores(pred: DataFrame, num_classes, keep, logits="logits") -> DataFrame:
    """Per class the probability `p{c}` and its logarithm `q{c}`, beside the `keep` columns.

    Written out per class in three projections, so that the exponentials are computed once and in
    generated code; array functions with lambdas are interpreted.
    """
    classes = range(num_classes)
    df = pred.select(*keep, *[F.get(F.col(logits), F.lit(c)).cast("double").alias(f"_l{c}") for c in classes])
    top = F.greatest(*[F.col(f"_l{c}") for c in classes]) if num_classes > 1 else F.col("_l0")
    df = df.withColumn("_top", top)
    df = df.withColumns({f"_e{c}": F.exp(F.col(f"_l{c}") - F.col("_top")) for c in classes})
    df = df.withColumn("_sum", sum((F.col(f"_e{c}") for c in classes), F.lit(0.0)))
    df = df.withColumn("_log", F.col("_top") + F.log("_sum"))
    return df.select(
        *keep,
        *[(F.col(f"_e{c}") / F.col("_sum")).alias(f"p{c}") for c in classes],
        *[(F.col(f"_l{c}") - F.col("_log")).alias(f"q{c}") for c in classes],
    )


def _valid(pred, num_classes, ignore_index, target, keys=()):
    df = drop_ignored(pred, target, ignore_index).withColumnRenamed(target, "_t")
    return class_scores(df, num_classes, [*keys, "_t"])


def eval_cross_entropy(pred: DataFrame, num_classes, weight=None, ignore_index=-1, label_smoothing=0.0, target="target"):
    """sum(w_t * nll) / sum(w_t), blended with the uniform term by the smoothing factor."""
    df = _valid(pred, num_classes, ignore_index, target)
    q = [F.col(f"q{c}") for c in range(num_classes)]
    w = _weights(weight, num_classes)
    eps = F.lit(float(label_smoothing))
    spread = sum((-q[c] * w[c] for c in range(num_classes)), F.lit(0.0)) / F.lit(float(num_classes))
    df = df.select(_at(w, F.col("_t")).alias("wt"), (-_at(q, F.col("_t"))).alias("nll"), spread.alias("sp"))
    mean = ((F.lit(1.0) - eps) * F.sum(F.col("wt") * F.col("nll")) + eps * F.sum("sp")) / F.sum("wt")
    return df.agg(mean.alias("cross_entropy"))


def eval_focal(pred: DataFrame, num_classes, alpha=None, gamma=2.0, ignore_index=-1, reduction="mean", target="target"):
    df = _valid(pred, num_classes, ignore_index, target)
    lp = _at([F.col(f"q{c}") for c in range(num_classes)], F.col("_t"))
    df = df.select(lp.alias("lp"), _at(_weights(alpha, num_classes), F.col("_t")).alias("wt"))
    value = F.pow(F.lit(1.0) - F.exp("lp"), F.lit(float(gamma))) * -F.col("lp") * F.col("wt")
    return df.agg((F.avg(value) if reduction == "mean" else F.sum(value)).alias("focal"))


def class_dice(pred: DataFrame, num_classes, smooth=1.0, ignore_index=-1, square=False, weight=None, target="target"):
    """Loss per class from 3 * num_classes sums gathered in one aggregate."""
    df = _valid(pred, num_classes, ignore_index, target)
    aggs = []
    for c in range(num_classes):
        p, hit = F.col(f"p{c}"), F.col("_t") == c
        aggs += [
            F.sum(F.when(hit, p).otherwise(0.0)).alias(f"i{c}"),
            F.sum(p * p if square else p).alias(f"p{c}"),
            F.sum(F.when(hit, 1.0).otherwise(0.0)).alias(f"t{c}"),
        ]
    w = _weights(weight, num_classes)
    s = F.lit(float(smooth))
    rows = [
        F.struct(
            F.lit(c).alias("class"),
            ((F.lit(1.0) - (F.lit(2.0) * F.col(f"i{c}") + s) / (F.col(f"p{c}") + F.col(f"t{c}") + s)) * w[c]).alias("dice"),
        )
        for c in range(num_classes)
    ]
    return df.agg(*aggs).filter(F.col("t0").isNotNull()).select(F.inline(F.array(*rows)))


def eval_dice(pred, num_classes, smooth=1.0, ignore_index=-1, square=False, weight=None, reduction="mean", target="target"):
    per = class_dice(pred, num_classes, smooth, ignore_index, square, weight, target)
    if reduction == "none":
        return per
    return per.agg((F.avg("dice") if reduction == "mean" else F.sum("dice")).alias("dice"))


def eval_dice_ce(pred, num_classes, dice_weight=1.0, ce_weight=1.0, smooth=1.0, ignore_index=-1, class_weight=None, label_smoothing=0.0, target="target"):
    parts = eval_dice(pred, num_classes, smooth, ignore_index, weight=class_weight, target=target).select(
        F.lit(float(dice_weight)).alias("w"), F.col("dice").alias("v")
    )
    ce = eval_cross_entropy(pred, num_classes, class_weight, ignore_index, label_smoothing, target)
    parts = parts.unionByName(ce.select(F.lit(float(ce_weight)).alias("w"), F.col("cross_entropy").alias("v")))
    return total_loss(parts).withColumnRenamed("total_loss", "dice_ce")


def total_loss(losses: DataFrame, weight="w", value="v") -> DataFrame:
    return losses.agg(F.sum(F.col(weight) * F.col(value)).alias("total_loss"))


def epoch_loss(batches: DataFrame, keys: list[str], loss="loss", size="batch_size") -> DataFrame:
    return batches.groupBy(*keys).agg(
        (F.sum(F.col(loss) * F.col(size)) / F.sum(size)).alias("epoch_loss")
    )


def _jaccard(gts, fg_before, bg_before, fg, bg):
    """Jaccard loss after the given foreground and background counts."""
    inter = gts - (fg_before + fg)
    union = gts + (bg_before + bg)
    return F.lit(1.0) - inter / union


def lovasz_gradient(errors: DataFrame, keys: list[str], err="err", fg="fg", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Steps of the Jaccard loss along descending errors, one row per distinct error value.

    Rows with equal errors are added up first: inside such a run the steps telescope, so the dot
    product with the errors does not change, and a large group of copies becomes a single row
    before anything is sorted.
    """
    g = errors.groupBy(*keys, err).agg(
        F.sum(F.col(fg).cast("long")).alias("_f"), F.sum(1 - F.col(fg).cast("long")).alias("_b")
    )
    g = ordered_prefix(g, keys, [F.col(err).desc()], sums={"_fb": "_f", "_bb": "_b"}, group_rows=group_rows)
    g = with_group_stats(g, keys, [F.sum("_f").alias("_gts")])
    first = (F.col("_fb") + F.col("_bb")) == 0
    before = F.when(first, F.lit(0.0)).otherwise(_jaccard(F.col("_gts"), F.col("_fb"), F.col("_bb"), F.lit(0), F.lit(0)))
    after = _jaccard(F.col("_gts"), F.col("_fb"), F.col("_bb"), F.col("_f"), F.col("_b"))
    return g.select(*keys, err, F.col("_f").alias("n_fg"), F.col("_b").alias("n_bg"), (after - before).alias("grad"))


def class_errors(pred: DataFrame, num_classes, ignore_index=-1, target="target", keys=()) -> DataFrame:
    """|1[target = c] - p_c| for every class that occurs in the group's targets."""
    df = _valid(pred, num_classes, ignore_index, target, keys)
    seen = df.select(*keys, F.col("_t").alias("class")).distinct()
    rows = []
    for c in range(num_classes):
        fg = (F.col("_t") == c).cast("int")
        rows.append(F.struct(F.lit(c).alias("class"), fg.alias("fg"), F.abs(fg - F.col(f"p{c}")).alias("err")))
    return df.select(*keys, F.inline(F.array(*rows))).join(seen, [*keys, "class"], "left_semi")


def eval_lovasz_softmax(pred, num_classes, ignore_index=-1, class_seen=None, per_image=None, target="target", group_rows: int = GROUP_ROWS):
    """Mean over the classes that occur; `per_image` names the image columns for the per-image mean."""
    keys = list(per_image or [])
    err = class_errors(pred, num_classes, ignore_index, target, keys)
    if class_seen is not None and not keys:
        err = err.filter(F.col("class").isin(list(class_seen)))
    per = lovasz_gradient(err, [*keys, "class"], group_rows=group_rows)
    per = per.groupBy(*keys, "class").agg(F.sum(F.col("err") * F.col("grad")).alias("loss"))
    if keys:
        per = per.groupBy(*keys).agg(F.avg("loss").alias("loss"))
    return per.agg(F.avg("loss").alias("lovasz_softmax"))


def eval_lovasz_hinge(binary: DataFrame, per_image: list[str] | None = None, logit="logit", label="label", ignore=None, group_rows: int = GROUP_ROWS):
    df = binary if ignore is None else drop_ignored(binary, label, ignore)
    keys = list(per_image or [])
    sign = F.lit(2.0) * F.col(label) - F.lit(1.0)
    err = df.select(*keys, (F.lit(1.0) - F.col(logit) * sign).alias("err"), F.col(label).alias("fg"))
    g = lovasz_gradient(err, keys, group_rows=group_rows)
    value = F.sum(F.greatest("err", F.lit(0.0)) * F.col("grad")).alias("loss")
    per = g.groupBy(*keys).agg(value) if keys else g.agg(value)
    return per.agg(F.avg("loss").alias("lovasz_hinge"))


def _labelled_edges(edges, points, batch, feature, label, id_col):
    """Source and neighbour feature and label on each edge."""
    src = points.select(*batch, F.col(id_col).alias("src"), F.col(feature).alias("f_src"), F.col(label).alias("l_src"))
    named = points.withColumnsRenamed({feature: "f_dst", label: "l_dst"})
    return gather_neighbours(edges, named, batch, ["f_dst", "l_dst"], id_col=id_col).join(src, [*batch, "src"])


def eval_label_consistency(edges, points, batch, num_classes, ignore_index=-1, logits="logits", label="label", id_col="point_id", loss_weight=1.0):
    """Mean squared distance of class probabilities over neighbour pairs of equal, valid label."""
    prob = _probabilities(points, num_classes, [*batch, id_col, label], logits)
    return _label_consistency(_labelled_edges(edges, prob, batch, logits, label, id_col), num_classes, ignore_index, loss_weight)


def knn_label_consistency(
    points, k, batch, num_classes, ignore_index=-1, logits="logits", label="label", id_col="point_id", loss_weight=1.0, coords=("x", "y", "z"), **knn
):
    """`eval_label_consistency` over the k nearest rows, whose probabilities and labels come with the edges."""
    prob = _probabilities(points, num_classes, [*batch, id_col, label, *coords], logits)
    src, dst = ({f"f_{end}": logits, f"l_{end}": label} for end in ("src", "dst"))
    e = knn_self(prob, k, batch, coords, id_col, src_attrs=src, dst_attrs=dst, **knn)
    return _label_consistency(e, num_classes, ignore_index, loss_weight)


def _probabilities(points, num_classes, keep, logits):
    prob = class_scores(points, num_classes, keep, logits)
    return prob.select(*keep, F.array(*[F.col(f"p{c}") for c in range(num_classes)]).alias(logits))


def _label_consistency(e, num_classes, ignore_index, loss_weight):
    classes = range(num_classes)
    e = e.filter((F.col("l_src") == F.col("l_dst")) & (F.col("l_src") != ignore_index))
    gap = [F.get("f_src", F.lit(c)) - F.get("f_dst", F.lit(c)) for c in classes]
    total = F.coalesce(F.sum(sum((g * g for g in gap), F.lit(0.0))), F.lit(0.0))
    mean = F.lit(float(loss_weight)) * total / F.greatest(F.count(F.lit(1)), F.lit(1))
    return e.agg(mean.alias("label_consistency"))


def eval_boundary_contrast(edges, points, batch, margin=0.5, ignore_index=-1, feature="feature", label="label", id_col="point_id", loss_weight=1.0):
    """Pull equal labels together, push different ones below the margin, on cosine similarity."""
    unit = points.withColumn(feature, l2_normalise(feature))
    e = _labelled_edges(edges, unit, batch, feature, label, id_col)
    e = e.filter((F.col("l_src") != ignore_index) & (F.col("l_dst") != ignore_index))
    cos, same = F.col("cos"), F.col("l_src") == F.col("l_dst")
    e = e.select(dot("f_src", "f_dst").alias("cos"), same.alias("same"))
    pos = F.coalesce(F.avg(F.when(F.col("same"), F.lit(1.0) - cos)), F.lit(0.0))
    neg = F.coalesce(F.avg(F.when(~F.col("same"), F.greatest(cos - F.lit(float(margin)), F.lit(0.0)))), F.lit(0.0))
    return e.agg((F.lit(float(loss_weight)) * (pos + F.lit(0.5) * neg)).alias("boundary_contrast"))
