"""Per-tile normalisation: a group statistic joined back, then column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions.vectors import clip
from cloudloom.operators.neighbors import knn_idw
from cloudloom.operators.ordering import join_rows, with_group_stats
from cloudloom.schemas import TILE

COORD = ("x", "y", "z")


def _stats(df, tile, cols, **aggs):
    """Adds `_{name}_{col}` for every aggregate and column."""
    return with_group_stats(df, tile, [f(c).alias(f"_{n}_{c}") for c in cols for n, f in aggs.items()])


def _drop(df):
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _or_one(c: Column) -> Column:
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def _to_range(unit: Column, target) -> Column:
    lo, hi = (float(v) for v in target)
    return unit if (lo, hi) == (0.0, 1.0) else unit * F.lit(hi - lo) + F.lit(lo)


def normalize_unit_sphere(df: DataFrame, tile=TILE) -> DataFrame:
    """Subtract the mean, divide by the largest norm (kept at 0 when all points coincide)."""
    df = centroid_shift(df, tile)
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in COORD), F.lit(0.0)))
    df = with_group_stats(df, tile, [F.max(norm).alias("_r")])
    return _drop(df.withColumns({c: F.col(c) / _or_one(F.col("_r")) for c in COORD}))


def standardize_coord(df: DataFrame, tile=TILE, apply_z=True) -> DataFrame:
    axes = COORD if apply_z else COORD[:2]
    df = _stats(df, tile, axes, m=F.avg, s=F.stddev_pop)
    return _drop(df.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / _or_one(F.col(f"_s_{c}")) for c in axes}))


def minmax_coord(df: DataFrame, tile=TILE, apply_z=True) -> DataFrame:
    axes = COORD if apply_z else COORD[:2]
    df = _stats(df, tile, axes, lo=F.min, hi=F.max)
    return _drop(
        df.withColumns({c: (F.col(c) - F.col(f"_lo_{c}")) / _or_one(F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in axes})
    )


def positive_shift(df: DataFrame, tile=TILE) -> DataFrame:
    df = _stats(df, tile, COORD, lo=F.min)
    return _drop(df.withColumns({c: F.col(c) - F.col(f"_lo_{c}") for c in COORD}))


def center_shift(df: DataFrame, tile=TILE, apply_z=True) -> DataFrame:
    """Centre of the box in the plane, its floor in z."""
    df = _stats(df, tile, COORD, lo=F.min, hi=F.max)
    cols = {c: F.col(c) - (F.col(f"_lo_{c}") + F.col(f"_hi_{c}")) / 2 for c in "xy"}
    if apply_z:
        cols["z"] = F.col("z") - F.col("_lo_z")
    return _drop(df.withColumns(cols))


def centroid_shift(df: DataFrame, tile=TILE, apply_z=True) -> DataFrame:
    axes = COORD if apply_z else COORD[:2]
    df = _stats(df, tile, axes, m=F.avg)
    return _drop(df.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in axes}))


def auto_intensity(df: DataFrame, tile=TILE, target=(0, 1), col="intensity") -> DataFrame:
    """Scale guessed from the tile's maximum: unit, 8 bit, 16 bit, else its own range."""
    df = _stats(df, tile, [col], lo=F.min, hi=F.max)
    v, lo, hi = F.col(col).cast("double"), F.col(f"_lo_{col}"), F.col(f"_hi_{col}")
    ranged = F.when(hi > lo, _to_range((v - lo) / _or_one(hi - lo), target)).otherwise(v)
    out = (
        F.when(hi <= 1.0, _to_range(v, target))
        .when(hi <= 255, _to_range(v / 255.0, target))
        .when(hi <= 65535, _to_range(v / 65535.0, target))
        .otherwise(ranged)
    )
    return _drop(df.withColumn(col, out))


def scale_intensity(df: DataFrame, max_value=65535.0, col="intensity") -> DataFrame:
    return df.withColumn(col, F.col(col) / F.lit(float(max_value)))


def _standardize(df, tile, col, mean, std):
    wanted = {}
    if mean is None:
        wanted["m"] = F.avg
    if std is None:
        wanted["s"] = F.stddev_pop
    if wanted:
        df = _stats(df, tile, [col], **wanted)
    m = F.col(f"_m_{col}") if mean is None else F.lit(float(mean))
    s = F.col(f"_s_{col}") if std is None else F.lit(float(std))
    return _drop(df.withColumn(col, (F.col(col) - m) / _or_one(s)))


def standardize_intensity(df: DataFrame, tile=TILE, mean=None, std=None, col="intensity") -> DataFrame:
    return _standardize(df, tile, col, mean, std)


def minmax_intensity(df: DataFrame, tile=TILE, lo=None, hi=None, target=(0, 1), col="intensity") -> DataFrame:
    """To the target range; a constant tile gets its midpoint."""
    df = _stats(df, tile, [col], lo=F.min, hi=F.max)
    a = F.col(f"_lo_{col}").cast("double") if lo is None else F.lit(float(lo))
    b = F.col(f"_hi_{col}").cast("double") if hi is None else F.lit(float(hi))
    mid = (float(target[0]) + float(target[1])) / 2
    out = F.when(a == b, F.lit(mid)).otherwise(_to_range((F.col(col) - a) / _or_one(b - a), target))
    return _drop(df.withColumn(col, out))


RGB = ("red", "green", "blue")


def auto_color(df: DataFrame, tile=TILE, target=(0, 255)) -> DataFrame:
    """One scale for all channels, guessed from their common maximum."""
    df = with_group_stats(
        df, tile, [F.min(F.least(*RGB)).alias("_lo"), F.max(F.greatest(*RGB)).alias("_hi")]
    )
    lo, hi = F.col("_lo").cast("double"), F.col("_hi").cast("double")

    def scaled(c):
        v = F.col(c).cast("double")
        byte = v if tuple(target) == (0, 255) else _to_range(v / 255.0, target)
        ranged = F.when(hi > lo, _to_range((v - lo) / _or_one(hi - lo), target)).otherwise(v)
        return (
            F.when(hi <= 1.0, _to_range(v, target))
            .when(hi <= 255, byte)
            .when(hi <= 65535, _to_range(v / 65535.0, target))
            .otherwise(ranged)
        )

    return _drop(df.withColumns({c: scaled(c) for c in RGB}))


def scale_color(df: DataFrame, source_bits=16, target=(0, 255)) -> DataFrame:
    top = float(2**source_bits - 1)
    return df.withColumns({c: _to_range(F.col(c) / F.lit(top), target) for c in RGB})


def clip_height(df: DataFrame, lo=None, hi=None, col="h_norm") -> DataFrame:
    return df.withColumn(col, clip(col, lo, hi))


def standardize_height(df: DataFrame, tile=TILE, mean=None, std=None, col="h_norm") -> DataFrame:
    return _standardize(df, tile, col, mean, std)


def log_height(df: DataFrame, eps=1e-6, col="h_norm") -> DataFrame:
    return df.withColumn(col, F.log(F.greatest(F.col(col), F.lit(0.0)) + F.lit(float(eps))))


def bin_height(df: DataFrame, bins=10, lo=0.0, hi=20.0, col="h_norm") -> DataFrame:
    """Equal-width bins closed on the left, clipped to the range, scaled to [0, 1]."""
    if bins < 2:
        raise ValueError("bin_height needs at least two bins")
    step = (float(hi) - float(lo)) / bins
    b = F.floor((F.col(col) - F.lit(float(lo))) / F.lit(step))
    return df.withColumn(col, clip(b, 0, bins - 1) / F.lit(float(bins - 1)))


def dtm_cells(df: DataFrame, tile=TILE, resolution=1.0) -> DataFrame:
    """Raster cell of each point over its tile's box. Only occupied cells are ever made, so a tile may be of any size."""
    df = _stats(df, tile, ("x", "y"), lo=F.min)
    cols = {f"c{c}": F.floor((F.col(c) - F.col(f"_lo_{c}")) / F.lit(float(resolution))) for c in "xy"}
    return _drop(df.withColumns(cols))


def dtm_raster(df: DataFrame, tile=TILE, resolution=1.0, **knn) -> DataFrame:
    """Height above a terrain raster: a cell is the mean ground z of its points; a point over an
    empty cell interpolates the three nearest ground points. Adds `ground_z` and `h_norm`."""
    tile = list(tile)
    cells = dtm_cells(df, tile, resolution)
    raster = cells.filter("is_ground").groupBy(*tile, "cx", "cy").agg(F.avg("z").alias("_cell_z"))
    got = join_rows(cells, raster, [*tile, "cx", "cy"])
    holes = got.filter(F.col("_cell_z").isNull()).select(*tile, "point_id", "x", "y")
    fill = knn_idw(holes, df.filter("is_ground"), "z", tile, ("x", "y"), 3, out="_fill_z", **knn)
    fill = fill.withColumnRenamed("src", "point_id").filter("point_id IS NOT NULL")
    got = join_rows(got, fill, [*tile, "point_id"]).withColumn("ground_z", F.coalesce("_cell_z", "_fill_z"))
    return _drop(got.withColumn("h_norm", F.col("z") - F.col("ground_z"))).drop("cx", "cy")


METHODS = ("lowest", "nearest", "raster")


def height_above_ground(df: DataFrame, tile=TILE, resolution=1.0, method="by_count", nearest_from=10, raster_from=50, **knn) -> DataFrame:
    """Adds h_norm, the height above the ground of the tile, and height_method, the method that gave it.

    `lowest`: above the lowest ground point, or the lowest point of a tile without ground; `nearest`: above the three nearest
    ground points; `raster`: above the raster of mean ground heights. `by_count`, the default, takes per tile `nearest` from
    `nearest_from` ground points on, `raster` from `raster_from` on, and `lowest` below. Naming a method takes it for all
    tiles; one without ground has no neighbours, and stays with `lowest`. Points without an id or a place in the plane are above
    the lowest ground where others are above the nearest. No row is lost.
    """
    tile = list(tile)
    if method != "by_count" and method not in METHODS:
        raise ValueError(f"unknown method {method}; known: by_count, {', '.join(METHODS)}")
    ground = F.col("is_ground")
    df = with_group_stats(
        df,
        tile,
        [
            F.count_if(ground).alias("_g"),
            F.min("z").alias("_zmin"),
            F.min(F.when(ground, F.col("z"))).alias("_gzmin"),
        ],
    )
    by_count = F.when(F.col("_g") >= raster_from, "raster").when(F.col("_g") >= nearest_from, "nearest").otherwise("lowest")
    chosen = by_count if method == "by_count" else F.when(F.col("_g") > 0, method).otherwise("lowest")
    df = df.withColumn("height_method", chosen)
    plain = df.filter("height_method = 'lowest'").withColumn("h_norm", F.col("z") - F.coalesce("_gzmin", "_zmin"))
    few = df.filter("height_method = 'nearest'")
    near = knn_idw(few, few.filter(ground), "z", tile, ("x", "y"), 3, out="_gz", **knn)
    near = near.withColumnRenamed("src", "point_id").filter("point_id IS NOT NULL")
    few = join_rows(few, near, [*tile, "point_id"])
    few = few.withColumn("h_norm", F.col("z") - F.coalesce("_gz", "_gzmin"))
    many = dtm_raster(_drop(df.filter("height_method = 'raster'")), tile, resolution, **knn).drop("ground_z")
    return _drop(plain).unionByName(_drop(few)).unionByName(many)
