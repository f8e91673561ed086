"""Voxel index of a tiled cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.operators.ordering import GROUP_ROWS, ordered_prefix, rank_by_id, with_group_stats
from cloudloom.schemas import TILE

VOXEL = ["vx", "vy", "vz"]


def voxel_coord(tiled: DataFrame, grid: float | None, tile: list[str] = TILE) -> DataFrame:
    """Integer cell per point, counted from the tile's minimum (the smallest cell is 0).
    `grid=None`: one voxel holds the whole tile."""
    if grid is None:
        return tiled.withColumns({v: F.lit(0).cast("long") for v in VOXEL})
    df = with_group_stats(tiled, tile, [F.min(c).alias(f"_m{c}") for c in "xyz"])
    cells = {v: F.floor((F.col(c) - F.col(f"_m{c}")) / F.lit(float(grid))) for v, c in zip(VOXEL, "xyz")}
    return df.withColumns(cells).drop("_mx", "_my", "_mz")


def voxel_key(voxels: DataFrame, tile: list[str] = TILE, out="voxel_key") -> DataFrame:
    """One BIGINT per voxel: mixed radix over the tile's cell extents, so it has no collisions."""
    df = with_group_stats(voxels, tile, [F.max("vy").alias("_my"), F.max("vz").alias("_mz")])
    key = (F.col("vx") * (F.col("_my") + 1) + F.col("vy")) * (F.col("_mz") + 1) + F.col("vz")
    return df.withColumn(out, key).drop("_my", "_mz")


def voxel_rank(voxels: DataFrame, tile: list[str] = TILE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds `voxel_rank` (0-based, in point order) and `voxel_n`."""
    return rank_by_id(voxels, [*tile, *VOXEL], "point_id", "voxel_rank", "voxel_n", tile, group_rows)


def voxel_table(voxels: DataFrame, tile: list[str] = TILE) -> DataFrame:
    return voxels.groupBy(*tile, *VOXEL).agg(F.count(F.lit(1)).alias("n"))


def voxel_counts(voxels: DataFrame, tile: list[str] = TILE) -> DataFrame:
    return (
        voxel_table(voxels, tile)
        .groupBy(*tile)
        .agg(F.count(F.lit(1)).alias("num_voxels"), F.max("n").alias("max_voxel_density"))
    )


def voxel_starts(voxels: DataFrame, tile: list[str] = TILE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Number of points in the voxels before each voxel, in cell order."""
    return ordered_prefix(voxel_table(voxels, tile), tile, VOXEL, sums={"start": "n"}, group_rows=group_rows)


def voxel_inverse(voxels: DataFrame, tile: list[str] = TILE, out="inverse", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Dense voxel number per point: numbers the voxel table, then joins it back."""
    numbered = ordered_prefix(
        voxels.select(*tile, *VOXEL).distinct(), tile, VOXEL, out, group_rows=group_rows
    )
    return voxels.join(numbered, [*tile, *VOXEL])


def voxel_sort(voxels: DataFrame, tile: list[str] = TILE, partitions: int | None = None) -> DataFrame:
    """Rows laid out in (tile, voxel, point) order for writing. Range partitioning on the full key
    splits a crowded tile over several tasks."""
    order = [*tile, *VOXEL, "point_id"]
    df = voxels.repartitionByRange(*([partitions] if partitions else []), *order)
    return df.sortWithinPartitions(*order)


def build_index(tiled: DataFrame, grid: float | None, tile: list[str] = TILE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`point_tile`: voxel, rank in voxel and voxel size for every (tile, point)."""
    df = voxel_rank(voxel_coord(tiled.select(*tile, "point_id", "x", "y", "z"), grid, tile), tile, group_rows)
    return df.select(*tile, "point_id", *VOXEL, "voxel_rank", "voxel_n")
