"""Scans, sinks, set operations, joins of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.catalog.base import (
    CLASSES, IX, MAPPING, PRD, PTS, SEG, T, TILES, TP, cells, cte, index, out, query, segmented, sql, tile_table, tiled,
)
from cloudloom.fixtures import POINT_EXPRS
from cloudloom.operators import project, quality, sampling, tiling, voting, voxels
from cloudloom.plans.jobs import tile_summary, vote_and_restore
from cloudloom.schemas import TILE
from cloudloom.session import new_table_path
from cloudloom.sources import points as src
from cloudloom.sources.records import scan_records, write_records

POINT_COLS = " ".join(c for c in POINT_EXPRS if c not in ("x", "y", "z", "normal_x", "normal_y", "normal_z"))
DBL = "x y z normal_x normal_y normal_z"

@query("scan_points", sql(PTS, "SELECT * FROM pts", POINT_COLS, DBL))
def _(t):
    path = new_table_path(t.spark, "points")
    t.points().write.partitionBy("file_id").parquet(path)
    got = src.scan_points(t.spark, path, columns=[*POINT_COLS.split(), *DBL.split()])
    return out(got.withColumn("file_id", F.col("file_id").cast("long")))


@query("scan_records", sql(PTS, "SELECT point_id AS orig_id, * FROM pts", "orig_id intensity return_number red", "x y z"))
def _(t):
    path = new_table_path(t.spark, "records")
    cols = [F.col("point_id").alias("orig_id"), "x", "y", "z", "intensity", "return_number", "red"]
    write_records(t.points().select(*cols), path)
    return out(scan_records(t.spark, path), "orig_id", "intensity", "return_number", "red", "x", "y", "z")


def _paths(t):
    p = t.points().select("point_id")
    bins = p.filter("point_id % 5 <> 0").select(F.concat(F.lit("cloud_"), "point_id", F.lit(".bin")).alias("path"))
    pkls = p.filter("point_id % 7 <> 0").select(F.concat(F.lit("cloud_"), "point_id", F.lit(".pkl")).alias("path"))
    return bins.unionByName(pkls)


@query(
    "pair_files",
    "SELECT concat('cloud_', o_orderkey) AS stem, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 'pair' "
    "WHEN o_orderkey % 7 <> 0 THEN 'no bin' ELSE 'no pkl' END AS status FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 7 <> 0",
)
def _(t):
    whole, lone = quality.pair_files(_paths(t))
    lone = lone.select("stem", F.concat(F.lit("no "), "lacks").alias("status"))
    return whole.select("stem", F.lit("pair").alias("status")).unionByName(lone)


@query("intersect_stems", "SELECT concat('cloud_', o_orderkey) AS stem FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def _(t):
    named = _paths(t).select(F.substring_index("path", ".", 1).alias("stem"), F.substring_index("path", ".", -1).alias("ext"))
    return quality.intersect_stems(named.filter("ext = 'bin'"), named.filter("ext = 'pkl'"))


@query("conform_fields", sql(PTS, "SELECT * EXCLUDE (classification), CAST(0 AS INTEGER) AS classification, CAST(NULL AS INTEGER) AS nir FROM pts", "file_id point_id intensity classification nir", "x y z"))
def _(t):
    return out(project.conform_fields(t.points().drop("classification")), "file_id", "point_id", "intensity", "classification", "nir", "x", "y", "z")


@query("write_tile_index", sql(TILES, "SELECT * FROM tiles", f"{T.replace(',', '')} num_points num_voxels max_voxel_density"))
def _(t):
    path = new_table_path(t.spark, "index")
    ix = index(t).select(*TILE, "point_id", "vx", "vy", "vz", "voxel_rank", "voxel_n")
    files = src.file_metadata(t.points(), parameters={"window_size": [256.0, 256.0], "grid_size": 32.0, "overlap_factor": 1})
    src.write_tile_index(path, files, tile_table(t), ix)
    got = src.read_tile_index(t.spark, path)
    n = got["point_tile"].groupBy(*TILE).agg(F.count(F.lit(1)).alias("_n"))
    kept = got["tiles"].join(n, TILE).join(got["files"].select("file_id"), "file_id").filter("num_points = _n")
    return kept.select(F.col("file_id").cast("long"), *TILE[1:], "num_points", "num_voxels", "max_voxel_density")


@query(
    "file_metadata",
    sql(
        cte(PTS, "f AS (SELECT file_id, count(*) AS num_points, min(x) AS x_offset, max(z) AS z_max FROM pts GROUP BY file_id)",
            "c AS (SELECT file_id, classification, count(*) AS n FROM pts GROUP BY ALL)"),
        f"SELECT *, {len(POINT_EXPRS)} AS fields, '1.2' AS version FROM f JOIN c USING (file_id)",
        "file_id num_points classification n fields version", "x_offset z_max",
    ),
)
def _(t):
    m = src.file_metadata(t.points())
    m = m.select("file_id", "num_points", F.size("fields").alias("fields"), "header.version", "header.x_offset", "header.z_max", F.explode("label_counts").alias("classification", "n"))
    return out(m)


SEGNAME = "format('{}_seg{:04d}', file_id, segment_id)"


@query("export_tiles_full", sql(cte(TP, SEG), f"SELECT *, {SEGNAME} AS tile_name FROM seg", "tile_name file_id point_id intensity", "x"))
def _(t):
    s = segmented(t).select("file_id", "segment_id", "point_id")
    return out(src.export_tiles_full(s, t.points()), "tile_name", "file_id", "point_id", "intensity", "x")


MOD = cte(
    IX,
    f"par AS (SELECT {T}, max(voxel_n) AS d FROM ix GROUP BY {T})",
    "lp AS (SELECT *, CASE WHEN d > 4 THEN 4 ELSE d END AS loops, CASE WHEN d > 4 THEN CAST(ceil(d / 4e0) AS BIGINT) ELSE 1 END AS ppl FROM par)",
    f"dr AS (SELECT ix.*, loops, ppl, unnest(range(voxel_rank, loops * ppl, voxel_n)) AS dd FROM ix JOIN lp USING ({T}))",
    "draws AS (SELECT *, CAST(dd // ppl AS INTEGER) AS loop_idx FROM dr)",
)


def draws(t):
    c = cells(t)
    return sampling.sample_voxel_modulo(voxels.voxel_rank(c), voxels.voxel_counts(c), 4)


@query(
    "export_tiles_grid",
    sql(
        cte(MOD, f"sid AS (SELECT DISTINCT {T}, CAST(dense_rank() OVER (PARTITION BY file_id ORDER BY pass_id, xb, yb) - 1 AS BIGINT) AS segment_id FROM tp)"),
        f"SELECT draws.*, format('{{}}_seg{{:04d}}_loop{{:02d}}', file_id, segment_id, loop_idx) AS tile_name FROM draws JOIN sid USING ({T})",
        "tile_name point_id red",
    ),
)
def _(t):
    d = tiling.tile_ids(draws(t).select(*TILE, "point_id", "loop_idx"))
    return src.export_tiles_grid(d, t.points()).select("tile_name", "point_id", "red")


VOTE = cte(
    PRD,
    "vs AS (SELECT file_id, point_id, count(*) AS votes, " + ", ".join(f"sum(logits[{c + 1}]) / count(*) AS m{c}" for c in range(CLASSES)) + " FROM prd GROUP BY file_id, point_id)",
    "vl AS (SELECT *, [" + ", ".join(f"m{c}" for c in range(CLASSES)) + "] AS ml FROM vs)",
    "vote AS (SELECT *, CAST(list_position(ml, list_max(ml)) - 1 AS INTEGER) AS label FROM vl)",
)
RESTORED = "SELECT pts.* EXCLUDE (classification), vote.label IS NOT NULL AS covered, CAST(coalesce(vote.label, 0) + 1 AS INTEGER) AS classification FROM pts LEFT JOIN vote USING (file_id, point_id)"


def votes(t):
    return voting.vote_label(voting.vote_logits(t.predictions(), CLASSES))


def restored(t):
    return voting.restore_votes(t.points(), votes(t), MAPPING)


@query("write_labelled_points", sql(VOTE, RESTORED, "file_id point_id classification covered intensity red", "x y z"))
def _(t):
    path = new_table_path(t.spark, "labelled")
    src.write_labelled_points(restored(t), path)
    got = t.spark.read.parquet(path).withColumn("file_id", F.col("file_id").cast("long"))
    return out(got, "file_id", "point_id", "classification", "covered", "intensity", "red", "x", "y", "z")


MCOLS = " ".join(f"m{c}" for c in range(CLASSES))


def means(df):
    return out(df.select(F.col("file_id").cast("long").alias("file_id"), "point_id", "votes", *[F.get("mean_logits", F.lit(c)).alias(f"m{c}") for c in range(CLASSES)]))


@query("write_mean_logits", sql(VOTE, "SELECT * FROM vote", "file_id point_id votes", MCOLS))
def _(t):
    path = new_table_path(t.spark, "logits")
    src.write_mean_logits(votes(t), path)
    return means(t.spark.read.parquet(path))


@query("write_predictions", sql(VOTE, "SELECT * FROM vote", "file_id point_id label"))
def _(t):
    path = new_table_path(t.spark, "labels")
    src.write_predictions(votes(t), path, "csv")
    got = t.spark.read.schema("point_id bigint, label int, file_id bigint").csv(path, header=True)
    return got.select("file_id", "point_id", "label")


@query("append_predictions", sql(PRD, "SELECT * FROM prd", "file_id point_id segment_id loop_idx batch_id"))
def _(t):
    path = new_table_path(t.spark, "parts")
    p = t.predictions()
    src.append_predictions(p.filter("loop_idx = 0"), path)
    src.append_predictions(p.filter("loop_idx > 0"), path)
    return t.spark.read.parquet(path).select(F.col("file_id").cast("long").alias("file_id"), "point_id", "segment_id", "loop_idx", "batch_id")


@query("union_passes", sql(
    cte(PTS, "org AS (SELECT file_id, min(x) AS x0, min(y) AS y0 FROM pts GROUP BY file_id)",
        "ps AS (SELECT CAST(i * 2 + j AS INTEGER) AS pass_id, i * 128e0 AS dx, j * 128e0 AS dy FROM (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j))"),
    "SELECT file_id, point_id, pass_id, CAST(floor((x - (x0 - dx)) / 256e0) AS BIGINT) AS xb, CAST(floor((y - (y0 - dy)) / 256e0) AS BIGINT) AS yb FROM pts JOIN org USING (file_id) CROSS JOIN ps",
    "file_id point_id pass_id xb yb"))
def _(t):
    return tiling.tile_overlap(t.points(), (256.0, 256.0), 2).select("file_id", "point_id", "pass_id", "xb", "yb")


@query("except_points", "SELECT o_orderkey % 2 AS file_id, o_orderkey AS point_id, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' ELSE 'extra' END AS status FROM orders WHERE (o_orderkey % 11 = 0) <> (o_orderkey % 13 = 0)")
def _(t):
    p = t.points()
    return quality.except_points(p.filter("point_id % 13 <> 0"), p.filter("point_id % 11 <> 0"))


@query("append_rows", sql(PTS, "SELECT file_id, point_id, x, false AS is_synthetic, intensity FROM pts UNION ALL SELECT file_id, NULL, x + 1, true, NULL FROM pts WHERE point_id % 10 = 0", "file_id point_id is_synthetic intensity", "x"))
def _(t):
    p = t.points().select("file_id", "point_id", "x", "intensity").withColumn("is_synthetic", F.lit(False))
    extra = t.points().filter("point_id % 10 = 0").select("file_id", (F.col("x") + 1).alias("x"), F.lit(True).alias("is_synthetic"))
    return out(quality.append_rows(p, extra), "file_id", "point_id", "is_synthetic", "intensity", "x")


@query("keep_union", sql(PTS, "SELECT DISTINCT file_id, point_id FROM pts WHERE point_id % 3 = 0 OR point_id % 5 = 0", "file_id point_id"))
def _(t):
    p = t.points().select("file_id", "point_id")
    return sampling.keep_union(p.filter("point_id % 3 = 0"), p.filter("point_id % 5 = 0"))


@query("tile_points", sql(TP, "SELECT * FROM tp", f"{T.replace(',', '')} point_id intensity classification", "x y z"))
def _(t):
    membership = tiled(t).select(*TILE, "point_id")
    return out(sampling.sample_full(membership, t.points()), *TILE, "point_id", "intensity", "classification", "x", "y", "z")


@query("sample_full", sql(TP, "SELECT * FROM tp", f"{T.replace(',', '')} point_id", "x"))
def _(t):
    m = tiled(t).select(*TILE, "point_id")
    return out(sampling.sample_full(m, t.points()), *TILE, "point_id", "x")


@query("missing_files", "SELECT o_orderkey % 1000 AS file_id, 'missing' AS status FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey % 7 <> 0) = 0 "
       "UNION ALL SELECT o_custkey + 1000000 AS file_id, 'unexpected' FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey % 10 = 0 GROUP BY 1")
def _(t):
    o = t.raw("orders")
    expected = o.select((F.col("o_orderkey") % 1000).alias("file_id"))
    seen = o.filter("o_orderkey % 7 <> 0")
    other = seen.filter("o_custkey % 10 = 0").select((F.col("o_custkey") + 1000000).alias("file_id"))
    return voting.missing_files(expected, seen.select((F.col("o_orderkey") % 1000).alias("file_id")).unionByName(other))


query("vote_logits", sql(VOTE, "SELECT * FROM vote", "file_id point_id votes", MCOLS))(
    lambda t: means(voting.vote_logits(t.predictions(), CLASSES))
)
query("vote_label", sql(VOTE, "SELECT * FROM vote", "file_id point_id label votes"))(
    lambda t: votes(t).select("file_id", "point_id", "label", "votes")
)
query("restore_votes", sql(VOTE, RESTORED, "file_id point_id classification covered"))(
    lambda t: restored(t).select("file_id", "point_id", "classification", "covered")
)
query("vote_and_restore", sql(VOTE, RESTORED, "file_id point_id classification covered"))(
    lambda t: vote_and_restore(t.points(), t.predictions(), CLASSES, MAPPING).select("file_id", "point_id", "classification", "covered")
)
query("vote_coverage", sql(
    cte(VOTE, "tot AS (SELECT file_id, count(*) AS num_points FROM pts GROUP BY file_id)", "gv AS (SELECT file_id, count(*) AS covered FROM vote GROUP BY file_id)"),
    "SELECT *, covered * 100e0 / num_points AS coverage FROM tot JOIN gv USING (file_id)", "file_id num_points covered", "coverage"))(
    lambda t: out(voting.vote_coverage(t.points(), votes(t)))
)
query("prediction_summary", sql(PRD, "SELECT count(DISTINCT batch_id) AS batches, count(*) AS rows, count(DISTINCT file_id) AS files FROM prd", "batches rows files"))(
    lambda t: voting.prediction_summary(t.predictions())
)

SLICE = cte(
    TILES,
    f"bx AS (SELECT {T}, " + ", ".join(f"{f}({c}) AS {c}_{f}" for c in "xyz" for f in ("min", "max")) + f" FROM tp GROUP BY {T})",
    f"lc AS (SELECT {T}, classification, count(*) AS n FROM tp GROUP BY {T}, classification)",
    f"lh AS (SELECT {T}, string_agg(concat(classification, ':', n), ',' ORDER BY classification) AS histogram FROM lc GROUP BY {T})",
)
BOX = " ".join(f"{c}_{e}" for c in "xyz" for e in ("min", "max"))
TILE_SUMMARY_SQL = sql(SLICE, f"SELECT * FROM tiles JOIN bx USING ({T}) JOIN lh USING ({T})", f"{T.replace(',', '')} num_points num_voxels max_voxel_density histogram", BOX)


@query("tile_summary", TILE_SUMMARY_SQL)
def summary(t):
    """The flagship: one row per tile of the cloud."""
    s = tile_summary(tiled(t), 32.0)
    pairs = F.transform(F.array_sort(F.map_entries("label_counts")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    s = s.withColumn("histogram", F.array_join(pairs, ","))
    return out(s, *TILE, "num_points", "num_voxels", "max_voxel_density", "histogram", *BOX.split())
