"""Draws of points from an indexed cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.seeded import hash_int, uniform
from cloudloom.operators.ordering import GROUP_ROWS, explode_range, ordered_prefix, with_group_stats
from cloudloom.operators.project import sampling_params
from cloudloom.operators.voxels import VOXEL, voxel_coord, voxel_counts, voxel_rank
from cloudloom.schemas import TILE


def sample_full(point_tile: DataFrame, points: DataFrame) -> DataFrame:
    return point_tile.join(points, ["file_id", "point_id"])


def sample_voxel_random(voxels: DataFrame, seed=0, epoch=0, tile: list[str] = TILE) -> DataFrame:
    """One point per voxel, uniform over its points, the same for the same seed and epoch.

    A minimum over the hash needs no rank and combines before the shuffle, so a crowded voxel
    costs no more than an empty one.
    """
    h = hash_int(seed, F.lit(epoch), "point_id", *tile)
    return (
        voxels.withColumn("_h", h)
        .groupBy(*tile, *VOXEL)
        .agg(F.min(F.struct("_h", "point_id")).alias("_m"), F.count(F.lit(1)).alias("voxel_n"))
        .select(*tile, *VOXEL, F.col("_m.point_id").alias("point_id"), "voxel_n")
    )


def sample_voxel_modulo(index: DataFrame, tiles: DataFrame, max_loops: int | None = None, tile: list[str] = TILE) -> DataFrame:
    """Draw d = loop*ppl + p takes the point with rank d mod n of each voxel, so the loops together
    visit every point. Needs no join: a point of rank r is drawn at r, r+n, r+2n, …

    `index` has voxel_rank and voxel_n, `tiles` the tile's max_voxel_density.
    """
    params = sampling_params(tiles.select(*tile, "max_voxel_density"), max_loops)
    df = index.join(params, tile)
    last = (F.col("loops") * F.col("ppl") - 1).cast("long")
    df = explode_range(df, "_d", F.col("voxel_rank"), last, F.col("voxel_n"))
    df = df.withColumn("loop_idx", F.floor(F.col("_d") / F.col("ppl")).cast("int"))
    return df.drop("_d", "max_voxel_density")


def draw_manifest(tiles: DataFrame, mode="full", split="train", max_loops=None, tile: list[str] = TILE) -> DataFrame:
    """One row per sample: a tile, or a (tile, loop) when a grid is drawn for test/predict."""
    keep = [*tile, "num_points", "num_voxels", "max_voxel_density"]
    t = sampling_params(tiles.select(*keep), max_loops)
    looped = mode == "grid" and split in ("test", "predict")
    loops = F.when(F.col("num_voxels") > 0, F.col("loops")).otherwise(1) if looped else F.lit(1)
    t = t.withColumn("loops", loops.cast("int"))
    return t.withColumn("loop_idx", F.explode(F.sequence(F.lit(0), F.col("loops") - 1)))


def sample_sizes(manifest: DataFrame, mode="full") -> DataFrame:
    n = F.col("num_points") if mode == "full" else F.when(
        F.col("num_voxels") > 0, F.col("num_voxels") * F.col("ppl")
    ).otherwise(F.lit(0))
    return manifest.withColumn("sample_points", n.cast("long"))


def grid_sample_train(points: DataFrame, grid: float, keep: DataFrame | None = None, seed=0, epoch=0, tile: list[str] = TILE) -> DataFrame:
    """One random point per voxel of the current coordinates, plus the ids of `keep`."""
    picked = sample_voxel_random(voxel_coord(points, grid, tile), seed, epoch, tile).select(*tile, "point_id")
    if keep is not None:
        picked = keep_union(picked, keep.select(*tile, "point_id"))
    return points.join(picked, [*tile, "point_id"], "left_semi")


def grid_sample_test(points: DataFrame, grid: float, tile: list[str] = TILE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """As many parts as the densest voxel has points; part i takes rank i mod n of each voxel."""
    voxels = voxel_coord(points, grid, tile)
    index = voxel_rank(voxels, tile, group_rows)
    return sample_voxel_modulo(index, voxel_counts(voxels, tile), None, tile).withColumnRenamed("loop_idx", "part_idx")


def voxel_geometry(points: DataFrame, grid: float, tile: list[str] = TILE, project=False) -> DataFrame:
    """grid_*, min_* and the displacement from the voxel centre in cell units, in [-0.5, 0.5);
    with `project` its component along the normal."""
    df = with_group_stats(points, tile, [F.min(c).alias(f"_m{c}") for c in "xyz"])
    cols = {}
    for c in "xyz":
        scaled = (F.col(c) - F.col(f"_m{c}")) / F.lit(float(grid))
        cols[f"grid_{c}"] = F.floor(scaled)
        cols[f"min_{c}"] = F.col(f"_m{c}")
        cols[f"disp_{c}"] = scaled - F.floor(scaled) - F.lit(0.5)
    df = df.withColumns(cols).drop("_mx", "_my", "_mz")
    if project:
        df = df.withColumn(
            "disp_normal", sum((F.col(f"disp_{c}") * F.col(f"normal_{c}") for c in "xyz"), F.lit(0.0))
        )
    return df


def keep_union(sampled: DataFrame, keep: DataFrame) -> DataFrame:
    return sampled.unionByName(keep).distinct()


def hashed_rank(points: DataFrame, seed: int, keys: list[str], out: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Position of each row in a seeded random order of its group."""
    df = points.withColumn("_h", hash_int(seed, "point_id"))
    return ordered_prefix(df, keys, ["_h", "point_id"], out, group_rows=group_rows).drop("_h")


def random_dropout(points: DataFrame, ratio=0.2, p=0.5, seed=0, keep: DataFrame | None = None, tile: list[str] = TILE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """With probability p per tile keeps int(n*(1-ratio)) random points, and always those of `keep`."""
    df = hashed_rank(points, seed, tile, "_r", group_rows)
    df = with_group_stats(df, tile, [F.count(F.lit(1)).alias("_n")])
    on = uniform(seed + 1, *tile) < F.lit(float(p))
    stay = ~on | (F.col("_r") < F.floor(F.col("_n") * F.lit(1.0 - ratio)))
    if keep is not None:
        df = df.join(keep.select(*tile, "point_id", F.lit(True).alias("_k")).distinct(), [*tile, "point_id"], "left")
        stay = stay | F.coalesce("_k", F.lit(False))
    return df.filter(stay).drop("_r", "_n", "_k")


def shuffle_points(points: DataFrame, seed=0, tile: list[str] = TILE, group_rows: int = GROUP_ROWS) -> DataFrame:
    return hashed_rank(points, seed, tile, "position", group_rows)


def weighted_draws(samples: DataFrame, order: str, weight: str, draws: int | None = None, seed=0, epoch=0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Draws with replacement, probability proportional to weight; as many draws as samples unless
    `draws` says otherwise.

    Samples become consecutive intervals of a line of length sum(weight), draws become points on
    it. The line is cut into as many cells as there are draws, an interval is repeated for each
    cell it touches (at most samples + draws rows in all), and the join is on the cell.
    """
    exact = F.col(weight).cast("decimal(28,12)")  # sums do not depend on their order, so intervals meet without gaps
    df = ordered_prefix(samples.withColumn("_w", exact), [], [order], sums={"_lo": "_w"}, group_rows=group_rows)
    df = df.withColumns({"_hi": (F.col("_lo") + F.col("_w")).cast("double"), "_lo": F.col("_lo").cast("double")}).drop("_w")
    total, n = samples.agg(F.sum(exact).cast("double"), F.count(F.lit(1))).first()
    if not total or total <= 0:
        raise ValueError("weights must have a positive sum")
    draws = n if draws is None else draws
    step = float(total) / draws
    cell = lambda c: F.least(F.floor(c / F.lit(step)), F.lit(draws - 1))
    df = explode_range(df.filter("_hi > _lo"), "_cell", cell(F.col("_lo")), cell(F.col("_hi")))
    u = samples.sparkSession.range(draws).select(
        F.col("id").alias("draw"), (uniform(seed, F.lit(epoch), "id") * F.lit(float(total))).alias("_u")
    )
    u = u.withColumn("_cell", cell(F.col("_u")))
    hit = u.join(df, "_cell").filter((F.col("_lo") <= F.col("_u")) & (F.col("_u") < F.col("_hi")))
    return hit.select("draw", *samples.columns)


def epoch_order(manifest: DataFrame, order: list[str], shuffle=True, seed=0, epoch=0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds `position`: sample order of an epoch, shuffled by seeded hash or natural."""
    if not shuffle:
        return ordered_prefix(manifest, [], order, "position", group_rows=group_rows)
    df = manifest.withColumn("_h", hash_int(seed, F.lit(epoch), *order))
    return ordered_prefix(df, [], ["_h", *order], "position", group_rows=group_rows).drop("_h")
