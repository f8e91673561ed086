"""Projections, tiling, voxel index, sampling, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.catalog.base import (
    GRID, IX, MAPPING, ORG, PRD, PTS, SEG, T, TILES, TP, V, VX, WINDOW, cells, cte, hash_sql, index, out, query, samples,
    segmented, sql, tile_table, tiled, tp_cte, uniform_sql, vx_cte, SMP,
)
from cloudloom.catalog.storage import BOX, MOD, SLICE, draws
from cloudloom.operators import project, quality, sampling, tiling, voxels
from cloudloom.plans.jobs import tile_cloud
from cloudloom.plans.transforms import pipeline
from cloudloom.schemas import TILE, TILE_PART

TC = T.replace(",", "")
KEY = ["file_id", "point_id"]

# --- projections ------------------------------------------------------------------------------
query(
    "select_assets",
    sql(PTS, "SELECT *, intensity / 65535e0 AS intensity_, CASE WHEN classification BETWEEN 1 AND 8 THEN classification - 1 ELSE -1 END AS class FROM pts", "file_id point_id class", "x y z intensity_").replace(" AS intensity_ FROM (", " AS intensity FROM ("),
)(lambda t: out(project.select_assets(t.points(), ["coord", "intensity", "class"], KEY, MAPPING)))
LOC = f"SELECT *, x - min(x) OVER w AS lx, y - min(y) OVER w AS ly, z - min(z) OVER w AS lz, min(x) OVER w AS offset_x FROM tp WINDOW w AS (PARTITION BY {T})"


@query("local_coord", sql(TP, LOC, f"{TC} point_id", "lx ly lz"))
def _(t):
    return out(project.local_coord(tiled(t), TILE).select(*TILE, "point_id", *[F.col(c).alias(f"l{c}") for c in "xyz"]))


@query("provenance_columns", sql(TP, LOC, f"{TC} point_id", "x lx offset_x"))
def _(t):
    local = project.local_coord(tiled(t), TILE, keep_offset=True).withColumn("lx", F.col("x"))
    kept = local.select(*TILE, "point_id", "lx", F.col("offset_x").alias("shift"), "x", "y", "z", *[f"offset_{c}" for c in "xyz"])
    back = project.global_coord(kept)
    return out(back.select(*TILE, "point_id", "x", "lx", F.col("shift").alias("offset_x")))


query("intensity_unit", sql(PTS, "SELECT file_id, point_id, intensity / 65535e0 AS unit FROM pts", "file_id point_id", "unit"))(
    lambda t: out(t.points().select(*KEY, project.intensity_unit()["intensity"].alias("unit")))
)
query("color_triplet", sql(PTS, "SELECT *, red::DOUBLE AS r, green::DOUBLE AS g, blue::DOUBLE AS b FROM pts", "file_id point_id", "r g b"))(
    lambda t: out(project.select_assets(t.points(), ["color"], KEY).select(*KEY, *[F.get("color", F.lit(i)).alias(c) for i, c in enumerate("rgb")]))
)
query("normal_triplet", sql(PTS, "SELECT *, normal_x AS nx, normal_y AS ny, normal_z AS nz FROM pts", "file_id point_id", "nx ny nz"))(
    lambda t: out(project.select_assets(t.points(), ["normal"], KEY).select(*KEY, *[F.get("normal", F.lit(i)).alias(f"n{c}") for i, c in enumerate("xyz")]))
)
query(
    "echo_flags",
    sql(PTS, "SELECT *, CASE WHEN return_number = 1 THEN 1 ELSE -1 END AS echo_first, CASE WHEN return_number = number_of_returns THEN 1 ELSE -1 END AS echo_last FROM pts", "file_id point_id echo_first echo_last"),
)(lambda t: project.select_assets(t.points(), ["echo"], KEY))
query("ground_flag", sql(PTS, "SELECT *, classification = 2 AS is_ground FROM pts", "file_id point_id is_ground"))(
    lambda t: project.ground_flag(t.points(), 2).select(*KEY, "is_ground")
)
MAPPED = "CASE WHEN classification BETWEEN 1 AND 8 THEN classification - 1 ELSE -1 END"
query("map_class", sql(PTS, f"SELECT *, {MAPPED} AS class FROM pts", "file_id point_id class"))(
    lambda t: t.points().select(*KEY, project.map_class("classification", MAPPING).alias("class"))
)
query(
    "unmap_class",
    sql(PTS, "SELECT *, CASE WHEN classification < 8 THEN classification + 1 ELSE -1 END AS ignored, CASE WHEN classification < 8 THEN classification + 1 ELSE classification END AS kept FROM pts", "file_id point_id ignored kept"),
)(
    lambda t: t.points().select(
        *KEY, project.unmap_class("classification", MAPPING).alias("ignored"), project.unmap_class("classification", MAPPING, "keep").alias("kept")
    )
)


@query("class_mapping", sql(PTS, "SELECT classification AS raw_label, classification - 1 AS train_label, count(*) AS n FROM pts WHERE classification BETWEEN 1 AND 8 GROUP BY 1, 2", "raw_label train_label n"))
def _(t):
    counts = t.points().groupBy(F.col("classification").alias("raw_label")).agg(F.count(F.lit(1)).alias("n"))
    return project.ClassMapping(MAPPING).table(t.spark).join(counts, "raw_label").select("raw_label", "train_label", "n")


@query("class_names", sql(PTS, f"SELECT *, CASE WHEN {MAPPED} < 0 THEN 'Class -1' ELSE concat('Class ', classification) END AS name FROM pts", "file_id point_id name"))
def _(t):
    m = project.ClassMapping(MAPPING)
    return t.points().select(*KEY, project.class_names(project.map_class("classification", m), 8, reverse=m.reverse).alias("name"))


query("argmax_label", sql(PRD, "SELECT *, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM prd", "file_id point_id loop_idx pred"))(
    lambda t: project.argmax_label(t.predictions()).select(*KEY, "loop_idx", "pred")
)
query("drop_ignored", sql(PRD, "SELECT * FROM prd WHERE target <> -1", "file_id point_id loop_idx target"))(
    lambda t: project.drop_ignored(t.predictions()).select(*KEY, "loop_idx", "target")
)


@query("pick_tiles", sql(cte(TP, SEG, "g AS (SELECT file_id, segment_id, count(*) AS n FROM seg WHERE segment_id IN (1, 3, 5, 7, 9, 900) GROUP BY ALL)"), "SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY segment_id) <= 3", "file_id segment_id n"))
def _(t):
    tiles = segmented(t).groupBy("file_id", "segment_id").agg(F.count(F.lit(1)).alias("n"))
    return project.pick_tiles(tiles, [1, 3, 5, 7, 9, 900], 3)


@query("limit_tiles", sql(cte(TP, SEG), "SELECT file_id, segment_id, count(*) AS n FROM seg WHERE segment_id < 4 GROUP BY ALL", "file_id segment_id n"))
def _(t):
    tiles = segmented(t).groupBy("file_id", "segment_id").agg(F.count(F.lit(1)).alias("n"))
    return project.pick_tiles(tiles, None, 4)


@query("collect_features", sql(PTS, "SELECT file_id, point_id, CAST(x AS FLOAT) AS f0, CAST(intensity AS FLOAT) AS f1, CAST(red AS FLOAT) AS f2, CAST(blue AS FLOAT) AS f4 FROM pts", "file_id point_id", "f0 f1 f2 f4"))
def _(t):
    p = t.points().withColumns(project.color_triplet())
    f = project.collect_features(p, KEY, ["x", "intensity", "color"])
    return out(f.select(*KEY, *[F.get("feat", F.lit(i)).alias(f"f{i}") for i in (0, 1, 2, 4)]))


query("set_columns", sql(PTS, "SELECT file_id, point_id, CAST(7 AS INTEGER) AS intensity, 'a' AS split FROM pts", "file_id point_id intensity split"))(
    lambda t: project.set_columns(t.points(), {"intensity": 7, "split": "a"}).select(*KEY, "intensity", "split")
)
query("coerce_types", sql(PTS, "SELECT file_id, point_id, CAST(classification AS BIGINT) AS classification, CAST(x AS FLOAT) AS x, classification = 2 AS is_ground FROM pts", "file_id point_id classification is_ground", "x"))(
    lambda t: out(project.coerce_types(project.ground_flag(t.points()).select(*KEY, "classification", "is_ground", "x")))
)
query("take_rows", sql(PTS, "SELECT * FROM pts WHERE classification = 3", "file_id point_id intensity", "x"))(
    lambda t: out(project.take_rows(t.points(), t.points().filter("classification = 3"), KEY), *KEY, "intensity", "x")
)


@query(
    "compose_transforms",
    sql(
        cte(TP, f"a AS (SELECT *, x - avg(x) OVER w AS cx, y - avg(y) OVER w AS cy FROM tp WINDOW w AS (PARTITION BY {T}))"),
        f"SELECT {T}, point_id, cx * 2 AS cx, cy * 2 AS cy, intensity / 65535e0 AS intensity FROM a WHERE classification <> 0",
        f"{TC} point_id", "cx cy intensity",
    ),
)
def _(t):
    steps = ["centroid_shift", ("aug_scale", {"scale": (2.0, 2.0)}), "scale_intensity", lambda d: d.filter("classification <> 0")]
    d = pipeline(tiled(t), steps)
    return out(d.select(*TILE, "point_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "intensity"))


query("repeat_dataset", sql(SMP, "SELECT sample_id, num_points, CAST(unnest(range(0, 3)) AS INTEGER) AS loop FROM smp", "sample_id num_points loop"))(
    lambda t: project.repeat_dataset(samples(t), 3).select("sample_id", "num_points", "loop")
)
query("sampling_params", sql(MOD, "SELECT * FROM lp", f"{TC} loops ppl"))(
    lambda t: project.sampling_params(tile_table(t), 4).select(*TILE, F.col("loops").cast("long"), F.col("ppl").cast("long"))
)

# --- tiling -----------------------------------------------------------------------------------
query("tile_assign", sql(TP, "SELECT * FROM tp", f"{TC} point_id"))(lambda t: tiled(t).select(*TILE, "point_id"))
query(
    "tile_overlap",
    sql(
        cte(PTS, ORG, "ps AS (SELECT unnest(range(0, 9)) AS p)"),
        "SELECT file_id, point_id, CAST(p AS INTEGER) AS pass_id, CAST(floor((x - (x0 - 250e0 * (p // 3) / 3)) / 250e0) AS BIGINT) AS xb, "
        "CAST(floor((y - (y0 - 250e0 * (p % 3) / 3)) / 250e0) AS BIGINT) AS yb FROM pts JOIN org USING (file_id) CROSS JOIN ps",
        f"{TC} point_id",
    ),
)(lambda t: tiling.tile_overlap(t.points(), (250.0, 250.0), 3).select(*TILE, "point_id"))
SMALL = 29
NEAR = cte(
    PTS, ORG, tp_cte(64.0),
    f"cen AS (SELECT {T}, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM tp GROUP BY {T})",
    f"near AS (SELECT s.file_id, s.pass_id, s.xb, s.yb, v.xb AS to_xb, v.yb AS to_yb, (s.cx - v.cx) * (s.cx - v.cx) + (s.cy - v.cy) * (s.cy - v.cy) AS dist2 "
    f"FROM cen s JOIN cen v ON s.file_id = v.file_id AND s.pass_id = v.pass_id AND s.n < {SMALL} AND v.n >= {SMALL} "
    "QUALIFY row_number() OVER (PARTITION BY s.file_id, s.pass_id, s.xb, s.yb ORDER BY dist2, v.xb, v.yb) = 1)",
)
query(
    "tile_merge_small",
    sql(NEAR, "SELECT tp.file_id, tp.pass_id, coalesce(to_xb, tp.xb) AS xb, coalesce(to_yb, tp.yb) AS yb, point_id FROM tp LEFT JOIN near "
        "ON tp.file_id = near.file_id AND tp.pass_id = near.pass_id AND tp.xb = near.xb AND tp.yb = near.yb", f"{TC} point_id"),
)(lambda t: tiling.tile_merge_small(tiled(t, (64.0, 64.0)), SMALL).select(*TILE, "point_id"))


@query("nearest_tile", sql(NEAR, "SELECT * FROM near", f"{TC} to_xb to_yb", "dist2"))
def _(t):
    c = tiling.tile_centroids(tiled(t, (64.0, 64.0)))
    return out(tiling.nearest_tile(c.filter(F.col("n") < SMALL), c.filter(F.col("n") >= SMALL)))


def _split_ctes(limit, rounds, src="tp"):
    """Rounds of halving at medians, by windows; the last table is c<rounds>."""
    parts = [f"c0 AS (SELECT *, CAST(1 AS BIGINT) AS part FROM {src})"]
    for i in range(rounds):
        key = f"{T}, part"
        parts.append(
            f"b{i} AS (SELECT *, count(*) OVER w AS n_, max(x) OVER w - min(x) OVER w >= max(y) OVER w - min(y) OVER w AS wx FROM c{i} WINDOW w AS (PARTITION BY {key}))"
        )
        parts.append(
            f"c{i + 1} AS (SELECT * EXCLUDE (part, n_, wx, r_), CASE WHEN n_ <= {limit} THEN part ELSE part * 2 + CASE WHEN r_ >= n_ // 2 THEN 1 ELSE 0 END END AS part "
            f"FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY CASE WHEN wx THEN x ELSE y END, point_id) - 1 AS r_ FROM b{i}))"
        )
    return cte(*parts)


def _split_sql(limit=150, rounds=7):
    return sql(cte(TP, _split_ctes(limit, rounds)), f"SELECT * FROM c{rounds}", f"{TC} part point_id")


def _cloud_sql(limit=150, rounds=7):
    """Windows, merging, splitting, ids and voxel index, one after another."""
    merged = (
        "mg AS (SELECT tp.* REPLACE (coalesce(to_xb, tp.xb) AS xb, coalesce(to_yb, tp.yb) AS yb) FROM tp LEFT JOIN near "
        "ON tp.file_id = near.file_id AND tp.pass_id = near.pass_id AND tp.xb = near.xb AND tp.yb = near.yb)"
    )
    seg = f"sg AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY file_id ORDER BY pass_id, xb, yb, part) - 1 AS BIGINT) AS segment_id FROM c{rounds})"
    cells = ", ".join(f"CAST(floor(({c} - min({c}) OVER (PARTITION BY file_id, segment_id)) / {GRID}e0) AS BIGINT) AS v{c}" for c in "xyz")
    v = "PARTITION BY file_id, segment_id, vx, vy, vz"
    return sql(
        cte(NEAR, merged, _split_ctes(limit, rounds, "mg"), seg, f"cv AS (SELECT *, {cells} FROM sg)"),
        f"SELECT *, row_number() OVER ({v} ORDER BY point_id) - 1 AS voxel_rank, count(*) OVER ({v}) AS voxel_n FROM cv",
        "file_id segment_id point_id vx vy vz voxel_rank voxel_n",
    )


@query("tile_cloud", _cloud_sql())
def _(t):
    return tile_cloud(t.points(), (64.0, 64.0), grid=GRID, min_points=SMALL, max_points=150)[2]


query("tile_split_large", _split_sql())(lambda t: tiling.tile_split_large(tiled(t), 150).select(*TILE_PART, "point_id"))
query("tile_ids", sql(cte(TP, SEG), "SELECT * FROM seg", f"{TC} segment_id point_id"))(lambda t: segmented(t).select(*TILE, "segment_id", "point_id"))


@query("tile_stats", sql(SLICE, f"SELECT * FROM tiles JOIN bx USING ({T})", f"{TC} num_points", BOX))
def _(t):
    return out(tiling.tile_stats(tiled(t)).select(*TILE, "num_points", "bounds.*"))


@query("tile_labels", sql(SLICE, "SELECT * FROM lc", f"{TC} classification n"))
def _(t):
    return tiling.tile_labels(tiled(t)).select(*TILE, F.explode("label_counts").alias("classification", "n"))


query("voxel_coord", sql(VX, "SELECT * FROM vx", f"{TC} point_id vx vy vz"))(lambda t: cells(t).select(*TILE, "point_id", "vx", "vy", "vz"))
query(
    "voxel_key",
    sql(cte(VX, f"vk AS (SELECT *, (vx * (max(vy) OVER w + 1) + vy) * (max(vz) OVER w + 1) + vz AS voxel_key FROM vx WINDOW w AS (PARTITION BY {T}))"), "SELECT * FROM vk", f"{TC} point_id voxel_key"),
)(lambda t: voxels.voxel_key(cells(t)).select(*TILE, "point_id", "voxel_key"))
query("voxel_rank", sql(IX, "SELECT * FROM ix", f"{TC} point_id vx vy vz voxel_rank voxel_n"))(
    lambda t: index(t).select(*TILE, "point_id", "vx", "vy", "vz", "voxel_rank", "voxel_n")
)
query("voxel_counts", sql(TILES, "SELECT * FROM tiles", f"{TC} num_voxels max_voxel_density"))(lambda t: voxels.voxel_counts(cells(t)))
query("no_voxel_mode", sql(TP, f"SELECT {T}, point_id, CAST(0 AS BIGINT) AS vx, row_number() OVER (PARTITION BY {T} ORDER BY point_id) - 1 AS voxel_rank, count(*) OVER (PARTITION BY {T}) AS voxel_n FROM tp", f"{TC} point_id vx voxel_rank voxel_n"))(
    lambda t: voxels.build_index(tiled(t), None).select(*TILE, "point_id", "vx", "voxel_rank", "voxel_n")
)
query("voxel_starts", sql(TILES, f"SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY {T} ORDER BY vx, vy, vz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM vt", f"{TC} vx vy vz n start"))(
    lambda t: voxels.voxel_starts(cells(t))
)
query("voxel_inverse", sql(VX, f"SELECT *, dense_rank() OVER (PARTITION BY {T} ORDER BY vx, vy, vz) - 1 AS inverse FROM vx", f"{TC} point_id inverse"))(
    lambda t: voxels.voxel_inverse(cells(t)).select(*TILE, "point_id", "inverse")
)
query("voxel_sort", sql(VX, "SELECT * FROM vx", f"{TC} vx vy vz point_id"))(lambda t: voxels.voxel_sort(cells(t)).select(*TILE, "vx", "vy", "vz", "point_id"))

# --- sampling ---------------------------------------------------------------------------------
PICK = hash_sql(5, "2", "point_id", "file_id", "pass_id", "xb", "yb")
query("sample_voxel_random", sql(VX, f"SELECT {V}, arg_min(point_id, {PICK}) AS point_id, count(*) AS voxel_n FROM vx GROUP BY {V}", f"{TC} vx vy vz point_id voxel_n"))(
    lambda t: sampling.sample_voxel_random(cells(t), seed=5, epoch=2)
)
query("sample_voxel_modulo", sql(MOD, "SELECT * FROM draws", f"{TC} point_id loop_idx voxel_rank"))(
    lambda t: draws(t).select(*TILE, "point_id", "loop_idx", "voxel_rank")
)
query("draw_manifest", sql(cte(MOD, "mf AS (SELECT *, CAST(unnest(range(0, loops)) AS INTEGER) AS loop_idx FROM lp)"), "SELECT * FROM mf", f"{TC} loop_idx"))(
    lambda t: sampling.draw_manifest(tile_table(t), "grid", "test", 4).select(*TILE, "loop_idx")
)
query(
    "sample_sizes",
    sql(cte(MOD, f"nv AS (SELECT {T}, count(*) AS v FROM (SELECT DISTINCT {V} FROM vx) GROUP BY {T})", "mf AS (SELECT *, CAST(unnest(range(0, loops)) AS INTEGER) AS loop_idx FROM lp)"),
        f"SELECT *, v * ppl AS sample_points FROM mf JOIN nv USING ({T})", f"{TC} loop_idx sample_points"),
)(lambda t: sampling.sample_sizes(sampling.draw_manifest(tile_table(t), "grid", "test", 4), "grid").select(*TILE, "loop_idx", "sample_points"))
PICK0 = hash_sql(9, "0", "point_id", "file_id", "pass_id", "xb", "yb")
query(
    "grid_sample_train",
    sql(VX, f"SELECT {T}, point_id FROM vx QUALIFY row_number() OVER (PARTITION BY {V} ORDER BY {PICK0}) = 1 OR point_id % 50 = 0", f"{TC} point_id"),
)(lambda t: sampling.grid_sample_train(tiled(t), GRID, tiled(t).filter("point_id % 50 = 0"), seed=9).select(*TILE, "point_id"))
query(
    "grid_sample_test",
    sql(cte(IX, f"pt AS (SELECT *, max(voxel_n) OVER (PARTITION BY {T}) AS d FROM ix)"), "SELECT *, CAST(unnest(range(voxel_rank, d, voxel_n)) AS INTEGER) AS part_idx FROM pt", f"{TC} point_id part_idx"),
)(lambda t: sampling.grid_sample_test(tiled(t), GRID).select(*TILE, "point_id", "part_idx"))
query("sample_to_parts", sql(cte(IX, f"pt AS (SELECT *, max(voxel_n) OVER (PARTITION BY {T}) AS d FROM ix)", f"pp AS (SELECT {T}, unnest(range(voxel_rank, d, voxel_n)) AS part_idx, red FROM pt)"),
     f"SELECT {T}, CAST(part_idx AS INTEGER) AS part_idx, count(*) AS n, CAST(sum(red) AS BIGINT) AS red FROM pp GROUP BY ALL", f"{TC} part_idx n red"))(
    lambda t: sampling.grid_sample_test(tiled(t), GRID).groupBy(*TILE, "part_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("red").alias("red"))
)
GEO = ", ".join(
    f"floor(({c} - min({c}) OVER w) / 32e0) AS g{c}, ({c} - min({c}) OVER w) / 32e0 - floor(({c} - min({c}) OVER w) / 32e0) - 0.5e0 AS disp_{c}" for c in "xyz"
)


@query("voxel_geometry", sql(cte(TP, f"ge AS (SELECT *, {GEO} FROM tp WINDOW w AS (PARTITION BY {T}))"),
       "SELECT *, CAST(gx AS BIGINT) AS grid_x, CAST(gz AS BIGINT) AS grid_z, disp_x * normal_x + disp_y * normal_y + disp_z * normal_z AS disp_normal FROM ge", f"{TC} point_id grid_x grid_z", "disp_x disp_y disp_z disp_normal"))
def _(t):
    return out(sampling.voxel_geometry(tiled(t), GRID, project=True), *TILE, "point_id", "grid_x", "grid_z", "disp_x", "disp_y", "disp_z", "disp_normal")


HR = hash_sql(3, "point_id")
query(
    "random_dropout",
    sql(cte(TP, f"hr AS (SELECT *, row_number() OVER (PARTITION BY {T} ORDER BY {HR}, point_id) - 1 AS r, count(*) OVER (PARTITION BY {T}) AS n, {uniform_sql(4, *TILE)} AS u FROM tp)"),
        "SELECT * FROM hr WHERE u >= 0.5 OR r < floor(n * 0.8e0) OR point_id % 40 = 0", f"{TC} point_id"),
)(lambda t: sampling.random_dropout(tiled(t), 0.2, 0.5, seed=3, keep=tiled(t).filter("point_id % 40 = 0")).select(*TILE, "point_id"))
query("shuffle_points", sql(TP, f"SELECT *, row_number() OVER (PARTITION BY {T} ORDER BY {HR}, point_id) - 1 AS position FROM tp", f"{TC} point_id position"))(
    lambda t: sampling.shuffle_points(tiled(t), seed=3).select(*TILE, "point_id", "position")
)
WD = cte(
    SMP,
    "iv AS (SELECT *, sum(weight) OVER (ORDER BY sample_id) AS hi, sum(weight) OVER () AS total, count(*) OVER () AS n FROM smp)",
    f"us AS (SELECT draw, {uniform_sql(6, '1', 'draw')} * (SELECT max(total) FROM iv) AS u FROM (SELECT unnest(range(0, (SELECT count(*) FROM smp))) AS draw))",
)


@query("weighted_draws", sql(WD, "SELECT * FROM us JOIN iv ON hi - weight <= u AND u < hi", "draw sample_id num_points"))
def _(t):
    return sampling.weighted_draws(samples(t), "sample_id", "weight", seed=6, epoch=1).select("draw", "sample_id", "num_points")


@query("draw_range_join", sql(WD, "SELECT sample_id, count(*) AS times FROM us JOIN iv ON hi - weight <= u AND u < hi GROUP BY sample_id", "sample_id times"))
def _(t):
    d = sampling.weighted_draws(samples(t), "sample_id", "weight", seed=6, epoch=1)
    return d.groupBy("sample_id").agg(F.count(F.lit(1)).alias("times"))


query("epoch_order", sql(SMP, f"SELECT *, row_number() OVER (ORDER BY {hash_sql(8, '3', 'sample_id')}, sample_id) - 1 AS position FROM smp", "sample_id position"))(
    lambda t: sampling.epoch_order(samples(t), ["sample_id"], seed=8, epoch=3).select("sample_id", "position")
)

# --- audits -----------------------------------------------------------------------------------


@query("index_coverage", sql(cte(PTS, "mem AS (SELECT file_id, point_id FROM pts WHERE point_id % 11 <> 0 UNION ALL SELECT file_id, point_id FROM pts WHERE point_id % 5 = 0 UNION ALL SELECT file_id, point_id + 10000000 FROM pts WHERE point_id % 100 = 0)",
       "mc AS (SELECT file_id, point_id, count(*) AS m FROM mem GROUP BY ALL)",
       "bo AS (SELECT coalesce(pts.file_id, mc.file_id) AS file_id, pts.point_id AS p, m FROM pts FULL JOIN mc ON pts.file_id = mc.file_id AND pts.point_id = mc.point_id)"),
       "SELECT file_id, CAST(sum(m) AS BIGINT) AS total, count(m) AS unique_points, count(*) FILTER (WHERE m IS NULL) AS missing, count(*) FILTER (WHERE p IS NULL) AS extra, CAST(sum(m - 1) AS BIGINT) AS duplicates, max(m) AS max_repeat, "
       "count(*) FILTER (WHERE m IS NULL OR p IS NULL) = 0 AS passed FROM bo GROUP BY file_id", "file_id total unique_points missing extra duplicates max_repeat passed"))
def _(t):
    p = t.points().select(*KEY)
    m = p.filter("point_id % 11 <> 0").unionByName(p.filter("point_id % 5 = 0"))
    m = m.unionByName(p.filter("point_id % 100 = 0").withColumn("point_id", F.col("point_id") + 10000000))
    return quality.index_coverage(t.points(), m)


def _audits(suffix, which, draws_of):
    """The audits of draws, on complete draws and on draws that lack some loops."""
    low = cte(MOD, f"cut AS (SELECT * FROM draws WHERE {which})", f"dp AS (SELECT {T}, point_id, count(*) AS times FROM cut GROUP BY ALL)", f"pc AS (SELECT {T}, count(*) AS points FROM tp GROUP BY {T})",
              f"sc AS (SELECT {T}, count(*) AS sampled, CAST(sum(times) AS BIGINT) AS draws, max(times) AS max_repeat FROM dp GROUP BY {T})")
    query(f"sampling_coverage{suffix}", sql(low, f"SELECT *, draws / sampled AS mean_repeat, sampled * 100e0 / points AS coverage, sampled = points AS passed FROM pc JOIN sc USING ({T})", f"{TC} points sampled draws max_repeat passed", "mean_repeat coverage"))(
        lambda t: out(quality.sampling_coverage(tiled(t).select(*TILE, "point_id"), draws_of(t)))
    )
    query(f"repeat_histogram{suffix}", sql(low, "SELECT times, count(*) AS points FROM dp GROUP BY times", "times points"))(lambda t: quality.repeat_histogram(draws_of(t)))
    query(
        f"strict_tile_coverage{suffix}",
        sql(cte(low, f"vv AS (SELECT {V}, count(*) FILTER (WHERE dp.point_id IS NULL) AS lost FROM ix LEFT JOIN dp USING ({T}, point_id) GROUP BY {V})"),
            f"SELECT {T}, CAST(sum(lost) AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, count(*) AS voxels, count(*) FILTER (WHERE lost = 0) AS full_voxels, count(*) FILTER (WHERE lost = 0) * 100e0 / count(*) AS full_share FROM vv GROUP BY {T}",
            f"{TC} missing extra voxels full_voxels", "full_share"),
    )(lambda t: out(quality.strict_tile_coverage(index(t), draws_of(t))))


_audits("", "true", draws)
_audits("_damaged", "loop_idx < 2", lambda t: draws(t).filter("loop_idx < 2"))


@query("validate_tiles", sql(cte(TILES, f"bad AS (SELECT * FROM tiles WHERE (xb + yb) % 2 = 0)"),
       "SELECT file_id, 'point_total' AS \"check\", CAST(1 AS BIGINT) AS \"rows\" FROM (SELECT DISTINCT file_id FROM bad) UNION ALL "
       "SELECT file_id, 'tile_count', count(*) FROM bad GROUP BY file_id UNION ALL SELECT file_id, 'bounds', count(*) FROM tiles WHERE xb = 2 GROUP BY file_id UNION ALL "
       "SELECT file_id, 'unknown_point', count(*) FROM tp WHERE point_id % 100 = 0 GROUP BY file_id",
       "file_id \"check\" \"rows\""))
def _(t):
    """A damaged index: half of the tiles report one point too many, one column of tiles has wrong
    bounds, and some points are unknown to the point table."""
    c = cells(t)
    tiles = tiling.tile_stats(c).join(voxels.voxel_counts(c), TILE)
    tiles = tiles.withColumn("num_points", F.col("num_points") + F.when((F.col("xb") + F.col("yb")) % 2 == 0, 1).otherwise(0))
    off = F.when(F.col("xb") == 2, F.lit(1.0)).otherwise(F.lit(0.0))
    tiles = tiles.withColumn("bounds", F.col("bounds").withField("z_max", F.col("bounds.z_max") + off))
    known = t.points()
    ix = voxels.voxel_rank(c)
    whole = quality.validate_tiles(known, tiles, ix)
    lost = quality.validate_tiles(known.filter("point_id % 100 <> 0"), tiles, ix).filter("check = 'unknown_point'")
    return whole.unionByName(lost)


@query("class_share", sql(PTS, "SELECT classification, count(*) AS n, count(*) * 100e0 / sum(count(*)) OVER () AS percent FROM pts GROUP BY classification", "classification n", "percent"))
def _(t):
    from cloudloom.operators.weights import class_share, label_counts

    return out(class_share(label_counts(t.points())))


@query("sample_determinism", sql(cte(VX, f"a AS (SELECT {T}, arg_min(point_id, {hash_sql(1, '0', 'point_id', 'file_id', 'pass_id', 'xb', 'yb')}) AS point_id FROM vx GROUP BY {V})", f"b AS (SELECT {T}, arg_min(point_id, {hash_sql(1, '1', 'point_id', 'file_id', 'pass_id', 'xb', 'yb')}) AS point_id FROM vx GROUP BY {V})"),
       "SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)", f"{TC} point_id only_in"))
def _(t):
    c = cells(t)
    one, two = (sampling.sample_voxel_random(c, 1, e).select(*TILE, "point_id") for e in (0, 1))
    return quality.sample_determinism(one, two)
