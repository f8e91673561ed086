"""Chains of steps: plans that name their input once, keys of any type, split tiles, made points, null keys."""

import pytest
from pyspark.sql import functions as F

from cloudloom.operators import augment, normalize, quality
from cloudloom.operators.ordering import attach_groups, with_group_stats
from cloudloom.operators.tiling import tile_assign, tile_split_large
from cloudloom.plans.transforms import pipeline
from cloudloom.schemas import TILE, TILE_PART

STEPS = [
    "centroid_shift", "center_shift", "standardize_coord", ("aug_rotate", {"p": 1.0, "seed": 1}),
    ("aug_rotate", {"p": 1.0, "seed": 2, "axis": "x"}), "normalize_unit_sphere",
]
TRAIN = [
    "centroid_shift", ("random_dropout", {"ratio": 0.2, "p": 1.0, "seed": 3}), ("aug_rotate", {"p": 0.5, "seed": 4}), ("aug_scale", {"seed": 5}),
    ("aug_flip", {"seed": 6}), ("aug_jitter", {"seed": 7}), ("collect_features", {"fields": ["coord", "intensity"]}),
]


@pytest.fixture(scope="module")
def stored(spark, cloud, tmp_path_factory):
    """The cloud as a Parquet table, whose scans a plan shows."""
    path = str(tmp_path_factory.mktemp("cloud") / "points")
    cloud.write.parquet(path)
    return path


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("n", range(len(STEPS) + 1))
def test_a_plan_names_its_input_once(spark, stored, n):
    df = pipeline(tile_assign(spark.read.parquet(stored), (25.0, 25.0)), STEPS[:n])
    assert scans(df) == 1
    assert df.count() == 900


def rounded(df, columns):
    return sorted(tuple(r) for r in df.select(*TILE, "point_id", *[F.round(c, 6) for c in columns]).collect())


def test_a_chain_is_its_steps_one_after_another(cloud):
    steps = [s for s in TRAIN if s[0] != "collect_features"]
    tiled = tile_assign(cloud, (25.0, 25.0))
    whole = pipeline(tiled, steps)
    for step in steps:
        tiled = pipeline(tiled, [step]).cache()
        tiled.count()
    assert rounded(whole, "xyz") == rounded(tiled, "xyz")


def test_split_tiles_are_normalised_by_part(cloud):
    split = tile_split_large(tile_assign(cloud, (50.0, 50.0)), 40)
    shifted = pipeline(split, ["center_shift", ("aug_rotate", {"p": 1.0, "seed": 1})], tile=TILE_PART)
    middle = normalize.center_shift(split, TILE_PART).groupBy(*TILE_PART).agg(*[(F.min(c) + F.max(c)).alias(c) for c in "xy"])
    assert middle.filter("abs(x) > 1e-6 OR abs(y) > 1e-6").count() == 0
    turns = shifted.groupBy(*TILE_PART).count().count()
    assert turns == split.select(*TILE_PART).distinct().count() > split.select(*TILE).distinct().count()
    explicit = pipeline(split, [("center_shift", {"tile": TILE})], tile=TILE_PART)
    assert rounded(explicit, "xyz") == rounded(normalize.center_shift(split, TILE), "xyz")


@pytest.mark.parametrize("name", ["aug_shift", "aug_rotate", "aug_flip", "aug_jitter", "aug_intensity_noise", "random_dropout", "aug_elastic"])
def test_file_ids_of_text(cloud, name):
    named = cloud.withColumn("file_id", F.concat(F.lit("cloud_"), "file_id"))
    got = pipeline(tile_assign(named, (25.0, 25.0)), [name])
    assert 0 < got.count() <= 900
    numbers = cloud.withColumn("file_id", F.col("file_id").cast("string"))  # numbers as text draw like numbers
    a, b = (pipeline(tile_assign(c, (25.0, 25.0)), [name]) for c in (cloud, numbers))
    as_text = lambda df: rounded(df.withColumn("file_id", F.col("file_id").cast("string")), "xyz")
    assert as_text(a) == as_text(b)


def test_made_points_go_through_later_steps(cloud):
    tiled = tile_assign(cloud, (25.0, 25.0))
    more = augment.add_noise_clusters(augment.add_outliers(tiled, p=1, ratio=0.05), p=1)
    n = more.count()
    assert n > 900 and more.select(*TILE, "point_id").distinct().count() == n
    late = pipeline(more, ["aug_jitter", ("aug_elastic", {"p": 1.0})])
    assert late.count() == n
    moved = more.alias("a").join(late.alias("b"), [*TILE, "point_id"]).filter("a.is_synthetic")
    assert moved.select(F.round(F.col("a.x") - F.col("b.x"), 9)).distinct().count() > 10


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,), (2.0,), (-3.0,)], "h_norm double")
    assert [r[0] for r in normalize.clip_height(df, -1.0, 1.0).collect()] == [None, 1.0, -1.0]


def test_rows_with_a_null_key_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "k string, v double")
    got = sorted((r["k"] or "", r["v"], r["m"]) for r in with_group_stats(df, ["k"], [F.max("v").alias("m")]).collect())
    assert got == [("", 5.0, 7.0), ("", 7.0, 7.0), ("a", 1.0, 3.0), ("a", 3.0, 3.0)]
    table = df.groupBy("k").agg(F.max("v").alias("m"))
    assert sorted(r["m"] for r in attach_groups(df, table, ["k"], small_rows=0).collect()) == [3.0, 3.0, 7.0, 7.0]


def test_height_methods(cloud):
    tiled = tile_assign(cloud, (25.0, 25.0)).withColumn("is_ground", F.col("classification") == 2)
    by_count = normalize.height_above_ground(tiled, resolution=5.0)
    assert by_count.count() == 900 and by_count.filter("h_norm IS NULL").count() == 0
    for method in normalize.METHODS:
        got = normalize.height_above_ground(tiled, resolution=5.0, method=method)
        assert {r[0] for r in got.select("height_method").distinct().collect()} <= {method, "lowest"} and got.count() == 900
    with pytest.raises(ValueError):
        normalize.height_above_ground(tiled, method="guess")


def test_one_lost_point_fails_the_audit(cloud):
    tiled = tile_assign(cloud, (1000.0, 1000.0))
    draws = tiled.select(*TILE, "point_id")
    assert quality.sampling_coverage(draws, draws).filter("NOT passed").count() == 0
    lost = draws.filter("point_id <> 0")
    assert quality.sampling_coverage(draws, lost).filter("NOT passed").count() == 1
