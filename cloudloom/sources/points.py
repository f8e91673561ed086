"""Parquet tables of the engine: point scan, tile index, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.operators.ordering import join_rows
from cloudloom.operators.project import conform_fields
from cloudloom.schemas import VLR, require


def scan_points(spark: SparkSession, path: str, files=None, columns=None) -> DataFrame:
    """A point table or a folder of them. `files` and `columns` reach the scan as partition or row
    group filters and as the read schema."""
    df = spark.read.parquet(path)
    if files is not None:
        df = df.filter(F.col("file_id").isin(list(files)))
    return df.select(*columns) if columns else df


def write_points(points: DataFrame, path: str, mode="overwrite") -> None:
    """Clustered by file; range partitioning on the point id keeps a large file in many tasks."""
    df = conform_fields(points)
    df.repartitionByRange("file_id", "point_id").write.mode(mode).partitionBy("file_id").parquet(path)


def file_metadata(points: DataFrame, num_segments: DataFrame | None = None, header: dict | None = None, parameters: dict | None = None, headers: DataFrame | None = None) -> DataFrame:
    """One row per file: counts, box, field list, label histogram, parameters, header and records.

    `headers` has one row per file, file_id and header fields, `vlrs` among them: its values come before those of
    `header`, which hold for every file without its own.
    """
    per_label = points.groupBy("file_id", "classification").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{c}_{e}") for c in "xyz" for e, f in (("min", F.min), ("max", F.max))],
    )
    out = per_label.groupBy("file_id").agg(
        F.sum("n").alias("num_points"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("classification", "n")))).alias("label_counts"),
        *[(F.min if e == "min" else F.max)(f"{c}_{e}").alias(f"{c}_{e}") for c in "xyz" for e in ("min", "max")],
    )
    given = {"version": "1.2", "point_format": 3, "system_identifier": "", "generating_software": "", "creation_date": "", "crs": None}
    given.update({f"{c}_scale": 0.001 for c in "xyz"})
    given.update(header or {})
    own = [c for c in headers.columns if c != "file_id"] if headers is not None else []
    if own:
        out = join_rows(out, headers.select("file_id", *[F.col(c).alias(f"_h_{c}") for c in own]), ["file_id"])

    def of_file(name, value):
        return F.coalesce(F.col(f"_h_{name}"), value) if name in own else value

    cols = [of_file(k, F.lit(v).cast("string" if v is None else _kind(v))).alias(k) for k, v in given.items() if k != "vlrs"]
    cols += [F.col(f"_h_{k}").alias(k) for k in own if k not in given and k != "vlrs" and not k.endswith("_offset")]
    box = [F.col(f"{c}_{e}") for c in "xyz" for e in ("min", "max")]
    # without a header the offset of the stored integers is the minimum
    offsets = [of_file(f"{c}_offset", F.col(f"{c}_min")).alias(f"{c}_offset") for c in "xyz" if f"{c}_offset" not in given]
    out = out.withColumn("header", F.struct(*cols, *offsets, F.col("num_points").alias("point_count"), *box))
    records = [(v["user_id"], v["record_id"], v["description"], bytes(v["record_data"])) for v in given.get("vlrs") or []]
    vlrs = F.array(*[F.struct(F.lit(a), F.lit(b), F.lit(c), F.lit(d)) for a, b, c, d in records]) if records else F.array()
    out = out.withColumn("vlrs", of_file("vlrs", vlrs.cast(VLR))).withColumn("fields", F.array(*[F.lit(c) for c in points.columns]))
    for k, v in (parameters or {}).items():
        out = out.withColumn(k, F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v))
    if num_segments is not None:
        out = out.join(num_segments, "file_id", "left")
    return out.drop(*[f"{c}_{e}" for c in "xyz" for e in ("min", "max")], *[f"_h_{c}" for c in own])


def _kind(v):
    return {bool: "boolean", int: "int", float: "double", str: "string"}[type(v)]


def write_tile_index(path: str, files: DataFrame, tiles: DataFrame, point_tile: DataFrame, mode="overwrite") -> None:
    """The three index tables. `point_tile` is sorted by tile and voxel inside its files, so a tile
    filter skips row groups."""
    files.write.mode(mode).parquet(f"{path}/files")
    tiles.write.mode(mode).partitionBy("file_id").parquet(f"{path}/tiles")
    order = [c for c in ("file_id", "pass_id", "xb", "yb", "part", "segment_id", "vx", "vy", "vz", "point_id") if c in point_tile.columns]
    laid = point_tile.repartitionByRange(*order).sortWithinPartitions(*order)
    laid.write.mode(mode).partitionBy("file_id").parquet(f"{path}/point_tile")


def read_tile_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("files", "tiles", "point_tile")}


def tile_names(df: DataFrame, base="file_id", segment="segment_id", loop: str | None = None) -> DataFrame:
    """`{base}_seg{0000}`, `_loop{00}` for a drawn tile, `_full` for a tile without voxels."""
    name = F.format_string("%s_seg%04d", F.col(base).cast("string"), F.col(segment))
    if loop:
        drawn = F.concat(name, F.format_string("_loop%02d", F.col(loop)))
        name = F.when(F.col(loop).isNotNull(), drawn).otherwise(F.concat(name, F.lit("_full")))
    return df.withColumn("tile_name", name)


def export_tiles_full(point_tile: DataFrame, points: DataFrame) -> DataFrame:
    """All points of each tile under the tile's name."""
    return tile_names(point_tile.join(points, ["file_id", "point_id"]))


def export_tiles_grid(draws: DataFrame, points: DataFrame) -> DataFrame:
    """One set per (tile, loop). Draws without a loop number are tiles without voxels."""
    return tile_names(draws.join(points, ["file_id", "point_id"]), loop="loop_idx")


def write_tiles(tiles: DataFrame, path: str, mode="overwrite") -> None:
    by = [c for c in ("file_id", "segment_id", "loop_idx") if c in tiles.columns]
    tiles.repartitionByRange(*by, "point_id").write.mode(mode).partitionBy(*by).parquet(path)


def write_labelled_points(labelled: DataFrame, path: str, mode="overwrite") -> None:
    """Every original column with the voted class, one folder per source file."""
    require(labelled, ["file_id", "point_id", "classification"], "labelled points")
    labelled.repartitionByRange("file_id", "point_id").write.mode(mode).partitionBy("file_id").parquet(path)


def write_mean_logits(votes: DataFrame, path: str, mode="overwrite") -> None:
    votes.repartitionByRange("file_id", "point_id").write.mode(mode).partitionBy("file_id").parquet(path)


def write_predictions(labels: DataFrame, path: str, fmt="parquet", mode="overwrite") -> None:
    """Labels per file, as parquet or as text."""
    df = labels.select("file_id", "point_id", "label").repartitionByRange("file_id", "point_id")
    w = df.sortWithinPartitions("file_id", "point_id").write.mode(mode).partitionBy("file_id")
    w.csv(path, header=True) if fmt == "csv" else w.parquet(path)


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Adds one run of predictions to the per-file parts."""
    df = predictions.repartitionByRange("file_id", "point_id")
    df.write.mode("append").partitionBy("file_id").parquet(path)
