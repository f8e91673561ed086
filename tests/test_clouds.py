import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import project, quality, sampling, tiling, voxels
from cloudloom.plans.jobs import tile_cloud
from cloudloom.schemas import TILE, TILE_PART


def test_split_keeps_every_point_and_the_limit(cloud):
    tiled = tiling.tile_assign(cloud, (25.0, 25.0))
    small = tiling.tile_split_large(tiled, 20, task_rows=160, bins=32, candidates=20)  # halves the crowded tile by histograms
    plain = tiling.tile_split_large(tiled, 20)
    cols = [*TILE_PART, "point_id"]
    assert small.select(*cols).exceptAll(plain.select(*cols)).isEmpty()
    assert small.count() == cloud.count() == small.select("file_id", "point_id").distinct().count()
    assert small.groupBy(*TILE_PART).count().agg(F.max("count")).first()[0] <= 20
    with pytest.raises(ValueError):
        tiling.tile_split_large(tiled, 0)


def test_merge_leaves_no_small_tile_beside_a_valid_one(cloud):
    tiled = tiling.tile_assign(cloud, (12.5, 12.5))
    before, after = (d.groupBy(*TILE).count().toPandas() for d in (tiled, tiling.tile_merge_small(tiled, 8)))
    assert (before["count"] < 8).any() and (before["count"] >= 8).any()
    for f, rows in after.groupby("file_id"):
        had_valid = (before[before.file_id == f]["count"] >= 8).any()
        assert not had_valid or (rows["count"] >= 8).all()
    assert after["count"].sum() == before["count"].sum()
    untouched = tiling.tile_merge_small(tiled, 100_000)  # no valid tile at all
    assert untouched.select(*TILE, "point_id").exceptAll(tiled.select(*TILE, "point_id")).isEmpty()


def test_voxel_rank_of_a_crowded_tile(cloud):
    cells = voxels.voxel_coord(tiling.tile_assign(cloud, (25.0, 25.0)), None)
    a, b = (voxels.voxel_rank(cells, group_rows=g).select(*TILE, "point_id", "voxel_rank", "voxel_n") for g in (16, 10_000))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("max_loops", [None, 3])
def test_modulo_draws_cover_every_point(cloud, max_loops):
    cells = voxels.voxel_coord(tiling.tile_assign(cloud, (25.0, 25.0)), 5.0)
    index, tiles = voxels.voxel_rank(cells), voxels.voxel_counts(cells)
    draws = sampling.sample_voxel_modulo(index, tiles, max_loops)
    report = quality.sampling_coverage(index, draws).toPandas()
    assert report["passed"].all() and (report["sampled"] == report["points"]).all()
    # each voxel gives ppl points per loop
    per = draws.groupBy(*TILE, "vx", "vy", "vz", "loop_idx", "ppl").count()
    assert per.filter("count <> ppl").isEmpty()


def test_random_draws_depend_on_seed_and_epoch_only(cloud):
    cells = voxels.voxel_coord(tiling.tile_assign(cloud, (25.0, 25.0)), 5.0)
    one = sampling.sample_voxel_random(cells, 1, 0)
    again = sampling.sample_voxel_random(cells.repartition(7), 1, 0)
    other = sampling.sample_voxel_random(cells, 1, 1)
    assert quality.sample_determinism(one, again).isEmpty()
    assert not quality.sample_determinism(one, other).isEmpty()


def test_full_tiling_job_is_valid(cloud):
    tiled, tiles, index = tile_cloud(cloud, (25.0, 25.0), grid=5.0, min_points=10, max_points=60)
    key = ["file_id", "segment_id"]
    assert quality.validate_tiles(cloud, tiles, index, tile=key).isEmpty()
    assert quality.index_coverage(cloud, index).filter("NOT passed").isEmpty()
    assert tiles.agg(F.max("num_points")).first()[0] <= 60


def test_dropout_and_shuffle_of_a_crowded_tile(cloud):
    tiled = tiling.tile_assign(cloud, (25.0, 25.0))
    a, b = (sampling.shuffle_points(tiled, 4, group_rows=g).select(*TILE, "point_id", "position") for g in (32, 10_000))
    assert a.exceptAll(b).isEmpty()
    kept = sampling.random_dropout(tiled, 0.25, 1.0).groupBy(*TILE).count()
    sizes = tiled.groupBy(*TILE).agg(F.floor(F.count(F.lit(1)) * 0.75).alias("want"))
    assert kept.join(sizes, TILE).filter("count <> want").isEmpty()


def test_mapping_rules():
    m = project.ClassMapping({2: 0, 5: 1, 6: 1})
    assert m.reverse == {0: 2, 1: 6} and m.num_classes == 2
    with pytest.raises(ValueError):
        project.ClassMapping({1: 0, 2: 2})
    with pytest.raises(TypeError):
        project.ClassMapping("abc")


def test_unknown_asset_and_missing_column(cloud):
    with pytest.raises(ValueError, match="unknown assets"):
        project.select_assets(cloud, ["classification"], ["point_id"])
    with pytest.raises(ValueError, match="available columns"):
        project.select_assets(cloud, ["echo"], ["point_id"])


def test_coerce_types_rejects_other_types(spark):
    with pytest.raises(TypeError):
        project.coerce_types(spark.sql("SELECT map(1, 2) AS m"))


def test_weighted_draws_follow_the_weights(spark):
    s = spark.createDataFrame(pd.DataFrame({"id": range(50), "w": [0.0] * 25 + [1.0] * 24 + [24.0]}))
    for limit in (10, 10_000):
        got = sampling.weighted_draws(s, "id", "w", draws=4000, seed=2, group_rows=limit).groupBy("id").count().toPandas()
        got = got.set_index("id")["count"]
        assert got.sum() == 4000 and got.index.min() >= 25
        assert 1800 < got[49] < 2200


def test_split_keeps_every_row(spark):
    """Copies of one position, ids beyond 2^53, null coordinates, ids and keys."""
    n = 2000
    rows = spark.range(n).select(
        F.when(F.col("id") % 100 != 1, F.lit(1)).alias("file_id"),
        F.when(F.col("id") % 100 != 2, F.lit((1 << 62)) + F.col("id") * 3).alias("point_id"),
        F.when(F.col("id") % 100 != 3, F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 37 % 1000) / 10)).alias("x"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 50 * 1.0).alias("y"), F.lit(0.0).alias("z"),
        F.lit(0).alias("pass_id"), F.lit(0).cast("long").alias("xb"), F.when(F.col("id") % 100 != 4, F.lit(0).cast("long")).alias("yb"),
    )
    a = tiling.tile_split_large(rows, 60)
    b = tiling.tile_split_large(rows, 60, task_rows=1100, bins=64, candidates=50)
    for got in (a, b):
        assert got.count() == n and got.filter("part IS NULL").count() == 0
        assert got.groupBy(*TILE_PART).count().agg(F.max("count")).first()[0] <= 60
    key = lambda d: sorted(map(str, d.filter("point_id IS NOT NULL").select("point_id", "part").collect()))
    assert key(a) == key(b)


def test_rows_with_nulls_come_back(spark):
    """43 points in, 43 points out, whatever lacks an id, a tile or a coordinate."""
    from cloudloom.operators import augment, neighbors, normalize, pooling

    rows = spark.range(43).select(
        F.lit(0).alias("file_id"), F.when(F.col("id") != 5, F.col("id")).alias("point_id"), F.lit(0).alias("pass_id"),
        F.when(F.col("id") != 6, F.lit(0).cast("long")).alias("xb"), F.lit(0).cast("long").alias("yb"),
        F.when(F.col("id") != 7, F.col("id") % 7 * 1.0).alias("x"), (F.col("id") % 5 * 1.0).alias("y"), (F.col("id") / 10).alias("z"),
        (F.col("id") % 3 == 0).alias("is_ground"), (F.col("id") * 1.0).alias("v"),
    )
    tile = ["file_id", "pass_id", "xb", "yb"]
    assert augment.aug_elastic(rows, ((1.0, 1.0),), p=1).count() == 43
    for method in ("lowest", "nearest", "raster"):
        got = normalize.height_above_ground(rows, method=method)
        assert got.count() == 43 and got.filter("h_norm IS NULL AND x IS NOT NULL AND point_id IS NOT NULL").count() == 0
    edges = neighbors.knn_self(rows, 3, tile)
    assert edges.filter("xb IS NULL").count() == 1  # alone in its tile, and its own neighbour
    assert edges.select("src").distinct().count() == 42  # all but the point without a place; null is one id
    fine = pooling.unpool_interp(rows, rows.filter("is_ground"), tile, "v", "point_id")
    assert fine.count() == 43 and fine.filter("unpooled IS NULL AND x IS NOT NULL AND point_id IS NOT NULL").count() == 0
    cells = pooling.pool_cells(rows, 2.0, tile)
    assert pooling.unpool_map(cells, pooling.grid_pool(rows, 2.0, tile, ["v"]), tile, ["v"]).count() == 43


def test_draws_differ_by_file_and_fraction(spark):
    from cloudloom.functions.seeded import hash_int

    ids = spark.range(200).withColumn("vx", F.col("id") % 20).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("file_id"), F.col("id").alias("point_id"), "vx")
    ids = ids.select("*", *[F.lit(0).cast("long").alias(c) for c in ("pass_id", "xb", "yb", "vy", "vz")])
    picked = sampling.sample_voxel_random(ids, seed=1).toPandas().pivot(index="vx", columns="file_id", values="point_id")
    assert (picked[0] != picked[1]).any()
    got = spark.createDataFrame([(0.2,), (0.7,), (2.0,)], "k double").select(hash_int(1, "k"), hash_int(1, F.col("k").cast("long"))).collect()
    assert got[0][0] != got[1][0] and got[2][0] == got[2][1]


def test_class_mapping_counts_before_it_joins(spark):
    from __spark_entry__ import queries

    plan = queries()["class_mapping"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # points are counted below the join, not moved by their few labels
