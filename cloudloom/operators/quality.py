"""Audits of an index, of draws and of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.voxels import VOXEL
from cloudloom.schemas import TILE


def except_points(expected: DataFrame, actual: DataFrame, keys=("file_id", "point_id")) -> DataFrame:
    """Rows of either side that the other lacks."""
    keys = list(keys)
    e, a = expected.select(*keys), actual.select(*keys)
    lost = e.subtract(a).withColumn("status", F.lit("missing"))
    return lost.unionByName(a.subtract(e).withColumn("status", F.lit("extra")))


def append_rows(df: DataFrame, *more: DataFrame) -> DataFrame:
    """The rows of all tables, by column name: null where a table lacks a column, and the wider of two types."""
    for other in more:
        df = df.unionByName(other, allowMissingColumns=True)
    return df


def intersect_stems(left: DataFrame, right: DataFrame, key="stem") -> DataFrame:
    return left.select(key).intersect(right.select(key))


def pair_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete (bin, pkl) pairs by stem and the stems that lack one half.

    `files` has a path column; one aggregate by stem answers both.
    """
    named = files.select(
        F.regexp_replace("path", r"\.[^.]*$", "").alias("stem"), F.regexp_extract("path", r"\.([^.]*)$", 1).alias("ext")
    ).filter(F.col("ext").isin("bin", "pkl"))
    half = named.groupBy("stem").agg(F.max((F.col("ext") == "bin")).alias("has_bin"), F.max((F.col("ext") == "pkl")).alias("has_pkl"))
    whole = half.filter("has_bin AND has_pkl").select(
        "stem", F.concat("stem", F.lit(".bin")).alias("bin_path"), F.concat("stem", F.lit(".pkl")).alias("pkl_path")
    )
    lone = half.filter("NOT (has_bin AND has_pkl)").select(
        "stem", F.when(F.col("has_bin"), "pkl").otherwise("bin").alias("lacks")
    )
    return whole, lone


def index_coverage(points: DataFrame, point_tile: DataFrame) -> DataFrame:
    """Per file: memberships, distinct points, missing, extra, repeated, most repeats, verdict.

    One full outer join of two keyed tables; memberships are counted before it.
    """
    key = ["file_id", "point_id"]
    seen = point_tile.groupBy(*key).agg(F.count(F.lit(1)).alias("_m"))
    both = points.select(*key, F.lit(1).alias("_p")).join(seen, key, "full")
    gone, extra = F.col("_m").isNull(), F.col("_p").isNull()
    out = both.groupBy("file_id").agg(
        F.coalesce(F.sum("_m"), F.lit(0)).alias("total"),
        F.count("_m").alias("unique_points"),
        F.count_if(gone).alias("missing"),
        F.count_if(extra).alias("extra"),
        F.coalesce(F.sum(F.col("_m") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.max("_m"), F.lit(0)).alias("max_repeat"),
    )
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("extra") == 0))


def draws_per_point(draws: DataFrame, tile=TILE) -> DataFrame:
    return draws.groupBy(*tile, "point_id").agg(F.count(F.lit(1)).alias("times"))


def sampling_coverage(point_tile: DataFrame, draws: DataFrame, tile=TILE) -> DataFrame:
    """Per tile: points, points drawn, draws per drawn point, share, and whether every point was drawn."""
    tile = list(tile)
    want = point_tile.groupBy(*tile).agg(F.count(F.lit(1)).alias("points"))
    got = draws_per_point(draws, tile).groupBy(*tile)
    got = got.agg(F.count(F.lit(1)).alias("sampled"), F.sum("times").alias("draws"), F.max("times").alias("max_repeat"))
    out = want.join(got, tile, "left").na.fill(0, ["sampled", "draws", "max_repeat"])
    return out.withColumns(
        {
            "mean_repeat": F.coalesce(F.try_divide(F.col("draws"), F.col("sampled")), F.lit(0.0)),
            "coverage": F.col("sampled") / F.col("points") * 100.0,
        }
    ).withColumn("passed", F.col("sampled") >= F.col("points"))


def repeat_histogram(draws: DataFrame, tile=TILE) -> DataFrame:
    """How many points were drawn r times."""
    return draws_per_point(draws, tile).groupBy("times").agg(F.count(F.lit(1)).alias("points"))


def repeat_range(draws: DataFrame, tile=TILE) -> DataFrame:
    return draws_per_point(draws, tile).agg(*[f("times").alias(n) for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])


def strict_tile_coverage(index: DataFrame, draws: DataFrame, tile=TILE) -> DataFrame:
    """Per tile: points never drawn, drawn points that are not its members, and how many of its
    voxels were visited whole."""
    tile = list(tile)
    key = [*tile, "point_id"]
    drawn = draws.select(*key).distinct().withColumn("_d", F.lit(1))
    both = index.select(*key, *VOXEL, F.lit(1).alias("_p")).join(drawn, key, "full")
    per_voxel = both.groupBy(*tile, *VOXEL).agg(
        F.count_if(F.col("_d").isNull()).alias("_lost"), F.count_if(F.col("_p").isNull()).alias("_extra")
    )
    out = per_voxel.groupBy(*tile).agg(
        F.sum("_lost").alias("missing"),
        F.sum("_extra").alias("extra"),
        F.count_if(F.col("vx").isNotNull()).alias("voxels"),
        F.count_if(F.col("vx").isNotNull() & (F.col("_lost") == 0)).alias("full_voxels"),
    )
    return out.withColumn("full_share", F.col("full_voxels") / F.col("voxels") * 100.0)


def validate_tiles(points: DataFrame, tiles: DataFrame, index: DataFrame, overlap=False, tile=TILE, tol=1e-6) -> DataFrame:
    """Violations, one row per check that fails; an empty table is a pass.

    `tiles` has num_points, num_voxels and bounds; `index` has the voxel, rank and voxel size.
    """
    tile = list(tile)
    total = points.groupBy("file_id").agg(F.count(F.lit(1)).alias("want"))
    held = tiles.groupBy("file_id").agg(F.sum("num_points").alias("got"))
    size = total.join(held, "file_id", "full").filter(F.lit(not overlap) & ~F.col("want").eqNullSafe(F.col("got")))
    size = size.select("file_id", F.lit("point_total").alias("check"), F.lit(1).cast("long").alias("rows"))
    stray = index.join(points.select("file_id", "point_id"), ["file_id", "point_id"], "left_anti")
    stray = stray.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"))
    stray = stray.select("file_id", F.lit("unknown_point").alias("check"), "rows")
    per_voxel = index.groupBy(*tile, *VOXEL).agg(
        F.count(F.lit(1)).alias("n"), F.max("voxel_n").alias("said"), F.max("voxel_rank").alias("top"),
        F.count_distinct("voxel_rank").alias("ranks"),
    )
    wrong = per_voxel.filter((F.col("n") != F.col("said")) | (F.col("top") != F.col("n") - 1) | (F.col("ranks") != F.col("n")))
    wrong = wrong.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows")).select("file_id", F.lit("voxel_rank").alias("check"), "rows")
    sums = per_voxel.groupBy(*tile).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_v"))
    box = index.select(*tile, "point_id").join(points.select("file_id", "point_id", "x", "y", "z"), ["file_id", "point_id"])
    box = box.groupBy(*tile).agg(*[f(c).alias(f"_{c}_{e}") for c in "xyz" for e, f in (("min", F.min), ("max", F.max))])
    met = tiles.join(sums, tile, "left").join(box, tile, "left")
    count_bad = ~F.col("num_points").eqNullSafe(F.col("_n")) | ~F.col("num_voxels").eqNullSafe(F.col("_v"))
    off = F.lit(False)
    for c in "xyz":
        for e in ("min", "max"):
            off = off | (F.abs(F.col(f"bounds.{c}_{e}") - F.col(f"_{c}_{e}")) > tol)
    checks = met.groupBy("file_id").agg(F.count_if(count_bad).alias("tile_count"), F.count_if(off).alias("bounds"))
    checks = checks.unpivot("file_id", ["tile_count", "bounds"], "check", "rows").filter("rows > 0")
    return size.unionByName(stray).unionByName(wrong).unionByName(checks)


def sample_determinism(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows in which two draws differ, with the side that has them."""
    a = first.exceptAll(second).withColumn("only_in", F.lit("first"))
    return a.unionByName(second.exceptAll(first).withColumn("only_in", F.lit("second")))
