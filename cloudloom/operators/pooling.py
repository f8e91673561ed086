"""Pooling over voxels, batch elements and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.neighbors import gather_neighbours, inverse_distance, knn_gather, knn_join
from cloudloom.operators.ordering import join_rows, with_group_stats
from cloudloom.operators.voxels import VOXEL

COORDS = ("x", "y", "z")


def pool_cells(points: DataFrame, grid: float, batch: list[str], start: tuple | None = None) -> DataFrame:
    """Pooling cell per point, counted from the batch minimum or from `start`."""
    if start is None:
        df = with_group_stats(points, batch, [F.min(c).alias(f"_m{c}") for c in COORDS])
    else:
        df = points.withColumns({f"_m{c}": F.lit(float(s)) for c, s in zip(COORDS, start)})
    cells = {v: F.floor((F.col(c) - F.col(f"_m{c}")) / F.lit(float(grid))) for v, c in zip(VOXEL, COORDS)}
    return df.withColumns(cells).drop(*[f"_m{c}" for c in COORDS])


def grid_pool(points: DataFrame, grid: float, batch: list[str], features: list[str], start=None) -> DataFrame:
    """Per (batch, cell): mean coordinate and the maximum of each feature."""
    cells = pool_cells(points, grid, batch, start)
    return cells.groupBy(*batch, *VOXEL).agg(
        *[F.avg(c).alias(c) for c in COORDS], *[F.max(f).alias(f) for f in features], F.count(F.lit(1)).alias("n")
    )


def segment_max_pool(points: DataFrame, batch: list[str], features: list[str]) -> DataFrame:
    """Maximum of each feature over the batch element, on every member. No batch: over all rows."""
    aggs = [F.max(f).alias(f"{f}_max") for f in features]
    return with_group_stats(points, batch, aggs)


def neighbour_max_pool(edges: DataFrame, points: DataFrame, batch: list[str], features: list[str]) -> DataFrame:
    got = gather_neighbours(edges, points, batch, features)
    return got.groupBy(*batch, "src").agg(*[F.max(f).alias(f) for f in features])


def knn_max_pool(points: DataFrame, k: int, batch: list[str], features: list[str], coords=COORDS, id_col="point_id", **knn) -> DataFrame:
    """`neighbour_max_pool` over the k nearest rows, whose features come with the edges."""
    got = knn_gather(points, k, batch, features, coords, id_col, **knn)
    return got.groupBy(*batch, "src").agg(*[F.max(f).alias(f) for f in features])


def unpool_map(cells: DataFrame, pooled: DataFrame, batch: list[str], features: list[str]) -> DataFrame:
    """The pooled value on each member point of the cell; null where the cell is not pooled."""
    right = pooled.select(*batch, *VOXEL, *[F.col(f).alias(f"{f}_pooled") for f in features])
    return join_rows(cells, right, [*batch, *VOXEL])


def unpool_interp(fine: DataFrame, coarse: DataFrame, batch: list[str], value: str, coarse_id: str, skip: str | None = None, k=3, id_col="point_id", **knn) -> DataFrame:
    """Inverse-distance value of the k nearest coarse points, plus the fine point's own `skip`; null without coarse points."""
    edges = knn_join(fine, coarse, k, batch, COORDS, id_col, coarse_id, **knn)
    got = inverse_distance(edges, coarse, batch, value, coarse_id, "_up").withColumnRenamed("src", id_col)
    out = join_rows(fine, got, [*batch, id_col])
    base = F.col("_up") if skip is None else F.col("_up") + F.col(skip)
    return out.withColumn("unpooled", base).drop("_up")
