"""The three jobs: tiling a cloud, drawing samples with inference and voting, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import metrics, tiling, voting, voxels
from cloudloom.operators.ordering import GROUP_ROWS
from cloudloom.operators.project import argmax_label
from cloudloom.schemas import TILE


def tile_summary(tiled: DataFrame, grid: float, tile=TILE, label="classification") -> DataFrame:
    """Per tile: points, voxels, densest voxel, box and class histogram.

    Two aggregates over the points and none of them keeps a row per point: (tile, voxel, class)
    counts with the box in one, then two small ones over its result.
    """
    tile = list(tile)
    cells = voxels.voxel_coord(tiled, grid, tile)
    box = [f(c).alias(f"{c}_{e}") for c in "xyz" for e, f in (("min", F.min), ("max", F.max))]
    fine = cells.groupBy(*tile, *voxels.VOXEL, label).agg(F.count(F.lit(1)).alias("n"), *box)
    merged = [(F.min if e == "min" else F.max)(f"{c}_{e}").alias(f"{c}_{e}") for c in "xyz" for e in ("min", "max")]
    per_voxel = fine.groupBy(*tile, *voxels.VOXEL).agg(F.sum("n").alias("n"), *merged)
    shape = per_voxel.groupBy(*tile).agg(
        F.sum("n").alias("num_points"),
        F.count(F.lit(1)).alias("num_voxels"),
        F.max("n").alias("max_voxel_density"),
        *merged,
    )
    hist = fine.groupBy(*tile, label).agg(F.sum("n").alias("n")).groupBy(*tile)
    hist = hist.agg(F.array_sort(F.collect_list(F.struct(label, "n"))).alias("_e"))
    return shape.join(hist, tile).select(
        *tile,
        "num_points",
        "num_voxels",
        "max_voxel_density",
        *[f"{c}_{e}" for c in "xyz" for e in ("min", "max")],
        F.map_from_entries("_e").alias("label_counts"),
        F.transform("_e", lambda e: e[label]).alias("unique_labels"),
    )


def tile_cloud(points: DataFrame, window=(50.0, 50.0), factor=1, grid: float | None = 0.5, min_points: int | None = 1000, max_points: int | None = None, group_rows: int = GROUP_ROWS):
    """Tiles a cloud: windows, merging of small tiles, splitting of large ones, ids, voxel index.

    Returns the tiled points (with segment_id), the tile table and the point_tile index.
    """
    tiled = tiling.tile_overlap(points, window, factor)
    key = list(TILE)
    if min_points is not None:
        tiled = tiling.tile_merge_small(tiled, min_points)
    if max_points is not None:
        tiled = tiling.tile_split_large(tiled, max_points)
        key.append("part")
    tiled = tiling.tile_ids(tiled, key, group_rows)
    key = ["file_id", "segment_id"]
    cells = voxels.voxel_coord(tiled, grid, key)
    index = voxels.voxel_rank(cells, key, group_rows).select(*key, "point_id", *voxels.VOXEL, "voxel_rank", "voxel_n")
    tiles = tiling.tile_stats(tiled, key).join(voxels.voxel_counts(cells, key), key)
    tiles = tiles.join(tiling.tile_labels(tiled, key), key)
    return tiled, tiles, index


def _logits(made) -> pa.ListArray:
    """Rows of logits as one Arrow list per row, without a Python object per row."""
    made = np.ascontiguousarray(made, dtype=np.float64)
    rows, classes = made.shape if made.ndim == 2 else (len(made), 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * classes), pa.array(made.ravel()))


def _predictor(points: DataFrame, model, keep: list[str]):
    """A function that adds the model's logits to the columns kept of one Arrow table, and its Spark schema."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", logits array<double>"

    def run(table: pa.Table) -> pa.Table:
        return table.select(keep).append_column("logits", _logits(model(table.to_pandas())))

    return run, schema


def predict_tiles(
    points: DataFrame, model: Callable[[pd.DataFrame], object], batch: list[str], keys: list[str],
    postprocess: Callable[[DataFrame], DataFrame] | None = None, max_rows: int | None = None, parts: bool = False,
) -> DataFrame:
    """Runs the user's model on each packed batch; `model` takes the batch as pandas rows and returns one list of logits per row.

    A task reads a batch as a stream of Arrow batches. A model that may see a packed batch in parts (`parts`) gets them one by one, so
    memory does not grow with the batch. Any other model needs the whole batch: one of more than `max_rows` rows is refused
    by its key as soon as the limit is passed, before the rest is read.
    """
    keep = [*batch, *[k for k in keys if k not in batch]]
    run, schema = _predictor(points, model, keep)

    def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from run(pa.Table.from_batches([b])).to_batches()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if max_rows is not None and n > max_rows:
                name = ", ".join(f"{k} = {b.column(k)[0].as_py()}" for k in batch)
                raise ValueError(f"batch {name} has more than {max_rows} rows; pack smaller ones, or allow parts")
        yield from run(pa.Table.from_batches(held)).to_batches()

    out = points.groupBy(*batch).applyInArrow(in_parts if parts else whole, schema)
    return postprocess(out) if postprocess else out


def predict_points(points: DataFrame, model: Callable[[pd.DataFrame], object], keys: list[str]) -> DataFrame:
    """The same for a model that looks at one point at a time: no grouping, no shuffle."""
    run, schema = _predictor(points, model, list(keys))

    def each(batches):
        for b in batches:
            yield from run(pa.Table.from_batches([b])).to_batches()

    return points.mapInArrow(each, schema)


def vote_and_restore(points: DataFrame, predictions: DataFrame, num_classes: int, mapping=None) -> DataFrame:
    """Predictions of all draws -> one class per original point."""
    votes = voting.vote_label(voting.vote_logits(predictions, num_classes))
    return voting.restore_votes(points, votes, mapping)


def evaluate(predictions: DataFrame, num_classes: int, ignore_index=-1, names=None, reverse=None):
    """Confusion table, per-class metrics and report of a prediction table."""
    cm = metrics.confusion_matrix(argmax_label(predictions), ignore_index)
    per = metrics.per_class_metrics(metrics.tp_fp_fn(cm, num_classes), num_classes, names, reverse)
    return cm, per, metrics.segmentation_report(per)
